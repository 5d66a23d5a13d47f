import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import plan_of
from panelforge.operators import ranking


def table(spark, groups):
    rows = [(g, i, float(v)) for g, vs in groups.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "g string, i int, v double")


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with most rows, a value holding a third of them, and values far outside the others."""
    rng = np.random.default_rng(5)
    hot = np.concatenate([np.zeros(700), rng.normal(size=1300), [1e12, -1e12, 3e15], rng.normal(size=200) * 1e-9])
    return table(spark, {"hot": hot, "b": rng.normal(size=40), "c": [1.0] * 9, "d": [2.0], "e": [7.0] * 500})


@pytest.mark.parametrize("group_rows", [5, 60, 300, 10_000])
def test_rank_counts_equal_brute_force(skewed, group_rows):
    got = ranking.rank_counts(skewed, ["g"], "v", "r", group_rows).toPandas().sort_values(["g", "i"])
    by = got.groupby("g")["v"]
    np.testing.assert_array_equal(got["r_below"], by.rank(method="min").to_numpy() - 1)
    np.testing.assert_array_equal(got["r_ties"], got.groupby(["g", "v"])["v"].transform("size"))
    np.testing.assert_array_equal(got["r_n"], by.transform("size"))
    assert len(got) == skewed.count()


def test_average_rank(skewed):
    got = ranking.rank_counts(skewed, ["g"], "v", "r", 60).withColumn("a", ranking.average_rank("r")).toPandas()
    np.testing.assert_array_equal(got["a"], got.groupby("g")["v"].rank(method="average"))


@pytest.mark.parametrize("group_rows", [3, 1000])
def test_quantile_buckets(spark, group_rows):
    df = table(spark, {"x": [1, 1, 2, 3, 4, 5, 6, 7, 8, 9]})
    got = ranking.rank_counts(df, ["g"], "v", "r", group_rows).withColumn("b", ranking.quantile_bucket("r", 5))
    assert [r.b for r in got.orderBy("i").collect()] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_a_hot_group_is_spread_over_tasks(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame(pd.DataFrame({"g": ["hot"] * 9000 + ["b", "c"] * 50, "v": rng.permutation(9100) / 7.0}))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        values = df.groupBy("g", "v").count().withColumnRenamed("count", "n")
        ranges = ranking._counted_ranges(values, ["g"], "v", "n")
        assert plan_of(ranges).count("Exchange ") == 2
        found = ranges.where("g = 'hot'").groupBy("__part").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found) >= 7 and max(r["count"] for r in found) < 2500


def test_small_batches_count_on(spark, skewed):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = ranking.value_ranks(skewed, ["g"], "v", "r").toPandas().sort_values(["g", "v"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for _, part in got.groupby("g"):
        assert (part.r_below.to_numpy() == np.cumsum(part.r_ties) - part.r_ties).all() and (part.r_n == part.r_ties.sum()).all()


@pytest.mark.parametrize("group_rows", [2, 7])
def test_infinite_and_nan_values_rank_as_in_a_window(spark, group_rows):
    inf, nan = float("inf"), float("nan")
    df = table(spark, {"x": [1, nan, 2, inf, -inf, 3, nan, 2, inf, 0.0, -0.0, 5e-324, 1.7e308, -1.7e308]})
    columns = ["i", "r_below", "r_ties", "r_n"]
    got = ranking.rank_counts(df, ["g"], "v", "r", group_rows).select(*columns).orderBy("i").collect()
    assert got == ranking.rank_counts(df, ["g"], "v", "r").select(*columns).orderBy("i").collect()


@pytest.mark.parametrize("accuracy", [2, 3, 1000])
def test_percentiles_leave_out_infinite_and_nan_values(spark, accuracy):
    inf, nan = float("inf"), float("nan")
    df = table(spark, {"x": [nan, inf, -inf, 4, 1.7e308, -1.7e308, 0, 5e-324, 1, 2, 2, 3] + [nan] * 10})
    got = ranking.exact_percentiles(df, "v", [0.0, 0.125, 0.25, 0.5, 1.0], list("abcde"), accuracy).first()
    assert tuple(got) == (-1.7e308, 0.0, 5e-324, 2.0, 1.7e308)


@pytest.mark.parametrize("accuracy", [5, 40, 500, 10_000])
def test_exact_percentiles(spark, skewed, accuracy):
    shares, names = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0], ["a", "b", "c", "d", "e", "f"]
    got = ranking.exact_percentiles(skewed, "v", shares, names, accuracy).first()
    want = np.percentile(skewed.toPandas()["v"], [100 * s for s in shares])
    np.testing.assert_allclose(list(got), want, rtol=1e-12)


def test_brackets_hold_few_rows(spark):
    rng = np.random.default_rng(9)
    values = rng.normal(size=200_000)
    df = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(16)
    got = ranking.exact_percentiles(df, "v", [0.1, 0.5, 0.9], ["a", "b", "c"], 1000).first()
    np.testing.assert_allclose(list(got), np.percentile(values, [10, 50, 90]), rtol=1e-13)
    assert ranking._disjoint([(3, 4), (0, 1), (1, 2), (3.5, 9)]) == [(0, 2), (3, 9)]


def test_percentiles_of_nothing_and_of_nulls(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    assert ranking.exact_percentiles(df, "v", [0.5], ["m"]).first().m is None
    df = spark.createDataFrame([(None,), (2.0,), (4.0,)], "v double")
    assert ranking.exact_percentiles(df, "v", [0.5], ["m"], 1).first().m == 3.0


def test_ranks_over_two_keys(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"d": rng.integers(0, 3, 600), "s": rng.integers(0, 2, 600), "v": rng.integers(0, 90, 600) / 7.0})
    df = spark.createDataFrame(pdf)
    got = ranking.rank_counts(df, ["d", "s"], "v", "r", 20).select("d", "s", "v", "r_below").distinct()
    pdf["want"] = pdf.groupby(["d", "s"])["v"].rank(method="min").astype(int) - 1
    assert sorted(map(tuple, got.collect())) == sorted(pdf.drop_duplicates().itertuples(index=False, name=None))
    assert got.where(F.col("r_below") < 0).count() == 0
