"""Series are dealt to as many tasks, or buckets, as the panel has rows for, whatever the session's settings."""

import datetime as dtm
import re

import pytest
from helpers import plan_of

from catalogue import queries as catalogue
from panelforge.operators import series
from panelforge.plans import signals, sizing, workflow
from panelforge.sources import staged, staging_scope

SUPPLIERS, DAYS, ROWS = 25, 100, 100
PARTS = SUPPLIERS * DAYS // ROWS


@pytest.fixture
def tables(spark, tmp_path, monkeypatch):
    """25 suppliers that ship a line on each of 100 days, tasks of 100 rows, and the plans that the signals stage."""
    day = dtm.datetime(1999, 1, 1)
    lines = [(s, day + dtm.timedelta(days=d), 1.0 + (s + d) % 7, 100.0 * (1 + s), (s * d % 11) / 100, (s + d) % 9 / 100)
             for s in range(SUPPLIERS) for d in range(DAYS)]
    spark.createDataFrame(lines, "l_suppkey long, l_shipdate timestamp_ntz, l_quantity double, l_extendedprice double, "
                                 "l_discount double, l_tax double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(s, s % 25, 10.0 * s) for s in range(SUPPLIERS)], "s_suppkey long, s_nationkey int, s_acctbal double") \
        .write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(sizing, "SERIES_ROWS", ROWS)
    plans = []
    monkeypatch.setattr(signals, "staged", lambda df: plans.append(plan_of(df)) or staged(df))
    with staging_scope(spark):
        yield str(tmp_path), plans


def dealt(plan):
    return re.findall(r"hashpartitioning\(asset#\d+L?, (\d+)\), (\w+)", plan)


@pytest.mark.parametrize("name", ["leverage", "mv_weights_free", "quantile_portfolios", "glob_union", "idiosyncratic_momentum"])
def test_tasks_of_a_signal_follow_its_rows(spark, tables, name):
    assert PARTS > spark.sparkContext.defaultParallelism
    sf, plans = tables
    catalogue.build()[name](spark, sf).collect()
    assert [dealt(p) for p in plans] == [[(str(PARTS), "REPARTITION_BY_NUM")]]


def test_buckets_of_a_stored_panel_follow_its_rows(spark, tables):
    sf, plans = tables
    catalogue.stored_panel(spark, sf).collect()
    assert f"SelectedBucketsCount: {PARTS} out of {PARTS}" in plans[0] and not dealt(plans[0])


def test_a_written_signal_is_dealt_by_its_rows(spark, tables, tmp_path):
    sf, plans = tables
    panel = catalogue._assets(spark, sf)
    for kept in ({}, {"max_rows": 0}):
        workflow.create_signal("standard", str(tmp_path / "signal"), panel, **kept)
    assert dealt(plans[0]) == [(str(PARTS), "REPARTITION_BY_NUM")]
    assert "REPARTITION_BY_NUM" not in plans[1]


def test_dealt_series_are_the_same_rows(spark, tables, series_of):
    rows = series_of({f"a{i}": [1.0, None, 2.0 + i] for i in range(5)})
    assert sorted(sizing.by_series(rows, 1000).collect(), key=str) == sorted(rows.collect(), key=str)
    assert sizing.by_series(rows, 0) is rows and sizing.by_series(rows, None) is rows
    assert sizing.series_parts(spark, 1) == spark.sparkContext.defaultParallelism
    joined = series.join_in_series(rows, rows.withColumnRenamed("x", "y"), "asset", "dt", 10 * PARTS * ROWS)
    assert dealt(plan_of(joined.withColumn("asset", joined.asset))) == [(str(10 * PARTS), "REPARTITION_BY_NUM")]
    assert joined.where("x <=> y").count() == rows.count()
