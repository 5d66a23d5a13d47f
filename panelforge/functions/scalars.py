"""Column expressions with the null, NaN and zero-division rules the library relies on."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a, b) -> Column:
    """a / b, null where b is 0 (plain division raises under ANSI mode)."""
    return F.try_divide(_col(a), _col(b))


def percent_to_fraction(c) -> Column:
    return _col(c) / F.lit(100.0)


def log_growth(c) -> Column:
    """log(1 + return). A total loss (-1) is -Infinity; below -1 it is NaN, so that what compounds it is undefined."""
    c = _col(c)
    return F.when(c > -1, F.log1p(c)).when(c == -1, F.lit(float("-inf"))).when(c < -1, F.lit(float("nan")))


def known(c) -> Column:
    """NaN as null."""
    c = _col(c)
    return F.when(~F.isnan(c), c)


def null_to_zero(c) -> Column:
    return F.coalesce(_col(c), F.lit(0.0))


def nan_to_zero(c) -> Column:
    return F.nanvl(_col(c), F.lit(0.0))


def present(c) -> Column:
    """Neither null nor NaN. ``~isnan`` alone would keep nulls, because ``isnan(null)`` is false."""
    return _col(c).isNotNull() & ~F.isnan(_col(c))


def row_total(columns) -> Column:
    """Sum across columns of one row, nulls counted as 0."""
    return reduce(add, [null_to_zero(c) for c in columns])


def drop_null_rows(df: DataFrame) -> DataFrame:
    """Drop rows holding a null in any column. Unlike ``na.drop`` this keeps NaN."""
    return df.where(reduce(and_, [F.col(c).isNotNull() for c in df.columns]))


def correlation(x, y) -> Column:
    """Pearson correlation as an aggregate; pairs with a null are skipped, a constant side gives null."""
    x, y = _col(x), _col(y)
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)
