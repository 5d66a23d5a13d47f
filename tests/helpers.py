"""Helpers that several test modules import."""

import datetime as dtm

DAY0 = dtm.date(2020, 1, 1)


def plan_of(df) -> str:
    """Executed plan before adaptive changes."""
    return df._jdf.queryExecution().executedPlan().toString()
