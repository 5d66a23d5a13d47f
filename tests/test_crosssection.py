import datetime as dtm
import math

import pytest
from helpers import DAY0, plan_of
from pyspark.sql import functions as F

from panelforge.functions import correlation, drop_null_rows, nan_to_zero, present, ratio
from panelforge.operators import crosssection as cs
from panelforge.plans import sizing

DAY1 = DAY0 + dtm.timedelta(days=1)


@pytest.mark.parametrize("max_dates", [None, 10])
def test_zscore(spark, max_dates):
    rows = [("a", DAY0, 1.0), ("b", DAY0, 2.0), ("c", DAY0, 3.0), ("d", DAY0, None), ("a", DAY1, 5.0)]
    df = spark.createDataFrame(rows, "asset string, dt date, m double")
    got = {(r.asset, r.dt): r.momentum_zscore for r in cs.cs_zscore(df, "m", max_dates=max_dates).collect()}
    assert got[("a", DAY0)] == pytest.approx(-1.0) and got[("c", DAY0)] == pytest.approx(1.0)
    assert got[("d", DAY0)] is None      # no value
    assert got[("a", DAY1)] is None      # one asset on the date


def test_zscore_of_equal_values_is_null(spark):
    df = spark.createDataFrame([("a", DAY0, 0.1), ("b", DAY0, 0.1)], "asset string, dt date, m double")
    assert [r.momentum_zscore for r in cs.cs_zscore(df, "m").collect()] == [None, None]


def test_alpha(spark):
    df = spark.createDataFrame([(2.0, 30.0), (None, 1.0)], "momentum_zscore double, specific_risk double")
    assert [(r.alpha, r.signal) for r in cs.to_alpha(df).collect()] == [(30.0, 2.0), (None, None)]


def test_price_filter_at_the_limit(spark):
    rows = [("a", DAY0, 5.0), ("a", DAY1, 6.0), ("b", DAY0, 5.01), ("b", DAY1, 1.0)]
    df = cs.lagged_price(spark.createDataFrame(rows, "asset string, dt date, price double"))
    assert [r.asset for r in cs.price_filter(df).collect()] == ["b"]
    assert sorted(r.asset for r in cs.price_filter(df, inclusive=True).collect()) == ["a", "b"]


EXPOSURES = [("a", 1.0, None, 1.0), ("b", None, 2.0, 0.0), ("z", None, 0.0, None)]


@pytest.fixture
def exposures(spark):
    rows = [(a, DAY0, *x) for a, *x in EXPOSURES]
    return spark.createDataFrame(rows, "asset string, dt date, X double, Y double, Z double")


def test_exposures_sum_to_one(exposures):
    got = {(r.asset, r.industry): r.exposure for r in cs.normalise_exposures(exposures, ["X", "Y", "Z"], "drop").collect()}
    assert got == {("a", "X"): 0.5, ("a", "Z"): 0.5, ("b", "Y"): 1.0}


def test_all_zero_exposures_score_zero(exposures):
    got = {(r.asset, r.industry): r.exposure for r in cs.normalise_exposures(exposures, ["X", "Y", "Z"]).collect()}
    assert {k: v for k, v in got.items() if k[0] == "z"} == {("z", c): 0.0 for c in "XYZ"}
    with pytest.raises(ValueError):
        cs.normalise_exposures(exposures, ["X"], "other")


@pytest.mark.parametrize("mode", ["score_zero", "drop"])
@pytest.mark.parametrize("bound", [None, 100])
def test_both_projections_agree(spark, exposures, mode, bound):
    momentum = spark.createDataFrame(
        [(DAY0, "X", 4.0), (DAY0, "Y", -1.0)], "dt date, industry string, momentum double")
    columns = ["X", "Y", "Z"]
    long = cs.project_exposures(cs.normalise_exposures(exposures, columns, mode), momentum, bound)
    wide = cs.project_exposures_wide(exposures, momentum, columns, mode, bound)
    want = {"a": 2.0, "b": -1.0, **({"z": 0.0} if mode == "score_zero" else {})}
    assert {r.asset: r.momentum_score for r in long.collect()} == want
    assert {r.asset: r.momentum_score for r in wide.collect()} == want


def test_wide_projection_shuffles_no_exposures(exposures, spark):
    momentum = spark.createDataFrame([(DAY0, "X", 4.0)], "dt date, industry string, momentum double")
    plan = plan_of(cs.project_exposures_wide(exposures, momentum, ["X", "Y", "Z"], max_dates=100))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_broadcast_only_within_its_bound(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = spark.range(10).withColumnRenamed("id", "dt")
        small = big.groupBy("dt").count()
        assert "BroadcastHashJoin" in plan_of(sizing.join_small(big, small, "dt", 100))
        assert "BroadcastHashJoin" not in plan_of(sizing.join_small(big, small, "dt", None))
        assert "BroadcastHashJoin" not in plan_of(sizing.join_small(big, small, "dt", 1 << 40))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sizes(spark):
    rows = [(DAY0,), (DAY0,), (DAY0 + dtm.timedelta(days=9),)]
    df = spark.createDataFrame(rows, "dt date")
    assert sizing.span_days(df) == 10 and sizing.largest_group(df, ["dt"]) == 2
    assert sizing.span_days(df.where("false")) == 0 and sizing.largest_group(df.where("false"), ["dt"]) == 0


def test_scalars(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 0.0), (nan, 2.0), (None, 2.0), (4.0, 2.0)], "a double, b double")
    assert [r.x for r in df.where(present("a")).select(ratio("a", "b").alias("x")).collect()] == [None, 2.0]
    assert df.select(nan_to_zero("a").alias("x")).collect()[1].x == 0.0
    kept = drop_null_rows(df).collect()
    assert len(kept) == 3 and math.isnan(kept[1].a)


def test_guarded_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 1.0, 5.0), (3.0, None, 5.0)], "x double, y double, k double")
    row = df.agg(correlation("x", "y").alias("xy"), correlation("x", "k").alias("xk")).first()
    assert row.xy == pytest.approx(-1.0) and row.xk is None


def test_unpivot_all_other_columns(spark):
    df = spark.createDataFrame([(DAY0, 1.0, None)], "dt date, p double, q double")
    got = {(r.quantile, r.ret) for r in cs.unpivot(df, ["dt"], None, "quantile", "ret").collect()}
    assert got == {("p", 1.0), ("q", None)}


def test_percent(spark):
    df = cs.to_fraction(spark.createDataFrame([(1.0, 2.0)], "ret double, price double"), "ret")
    assert df.first() == (0.01, 2.0)
    assert df.select(F.col("ret")).count() == 1
