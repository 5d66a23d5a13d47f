import datetime as dtm

import numpy as np
import pandas as pd
import pytest
from helpers import DAY0, plan_of
from pyspark.sql import functions as F

from panelforge.operators import series


def by_asset(df, column):
    rows = df.orderBy("asset", "dt").select("asset", column).toPandas()
    return {a: g[column].to_numpy(dtype=float) for a, g in rows.groupby("asset")}


@pytest.fixture(scope="module")
def noisy():
    rng = np.random.default_rng(7)
    out = {}
    for name, n in [("a", 900), ("b", 300), ("c", 21), ("d", 22)]:
        x = rng.normal(0.0, 0.02, n)
        out[name] = [None if rng.random() < 0.05 else float(v) for v in x]
    return out


def pandas_vol(values, min_periods):
    s = pd.Series([np.nan if v is None else v for v in values], dtype=float)
    return s.ewm(span=22, min_periods=max(min_periods, 2), ignore_na=False).std().where(s.notna()).to_numpy()


@pytest.mark.parametrize("options", [{}, {"block_rows": 2}, {"block_rows": 8}, {"block_rows": 64}, {"block_rows": 512}])
@pytest.mark.parametrize("min_periods", [1, 22])
def test_ewm_std_equals_pandas(series_of, noisy, options, min_periods):
    got = by_asset(series.ewm_std(series_of(noisy), "asset", "dt", "x", 22, min_periods, "vol", **options), "vol")
    for name, values in noisy.items():
        np.testing.assert_allclose(got[name], pandas_vol(values, min_periods), rtol=1e-9, atol=1e-15)


def test_ewm_std_of_a_series_longer_than_the_weights_reach(series_of):
    rng = np.random.default_rng(1)
    values = {"long": list(rng.normal(0, 0.01, 9000))}
    got = by_asset(series.ewm_std(series_of(values), "asset", "dt", "x", 22, 22, "vol"), "vol")["long"]
    np.testing.assert_allclose(got, pandas_vol(values["long"], 22), rtol=1e-8)
    assert np.isfinite(got[22:]).all()


def test_ewm_std_short_span_uses_short_blocks(series_of):
    rng = np.random.default_rng(2)
    values = list(rng.normal(0, 1, 2000))
    got = by_asset(series.ewm_std(series_of({"a": values}), "asset", "dt", "x", 2, 1, "vol"), "vol")["a"]
    want = pd.Series(values).ewm(span=2).std().to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-7)


def test_constant_series_has_zero_vol_and_null_scaled_return(series_of):
    df = series.vol_scaled_momentum(series_of({"a": [0.03] * 300}), "asset", "dt", "x")
    row = df.agg(F.max("vol").alias("v"), F.count("scaled_ret").alias("s"), F.count("momentum").alias("m")).first()
    assert row["v"] == 0.0 and row["s"] == 0 and row["m"] == 0


@pytest.mark.parametrize("n", [1, 4, 5, 9, 10, 11, 63])
def test_rolling_sum_equals_pandas(series_of, n):
    rng = np.random.default_rng(n)
    values = [None if i in (17, 40) else float(rng.normal()) for i in range(n)]
    got = by_asset(series.rolling_sum(series_of({"a": values}), "asset", "dt", "x", 5, "s"), "s")["a"]
    want = pd.Series(values, dtype=float).rolling(5).sum().to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-12, atol=1e-12)


def test_rolling_sum_after_leading_nulls(series_of):
    values = [None] * 3 + [float(i) for i in range(20)]
    got = by_asset(series.rolling_sum(series_of({"a": values}), "asset", "dt", "x", 5, "s"), "s")["a"]
    np.testing.assert_allclose(got, pd.Series(values, dtype=float).rolling(5).sum().to_numpy())


def test_rolling_sum_forgets_a_far_out_value(series_of):
    values = [1.0] * 6 + [1e17] + [1.0] * 40
    got = by_asset(series.rolling_sum(series_of({"a": values}), "asset", "dt", "x", 5, "s"), "s")["a"]
    assert (got[20:] == 5.0).all()


@pytest.mark.parametrize("n", [229, 230, 251, 252, 253, 280])
def test_momentum_burn_in(series_of, n):
    rng = np.random.default_rng(n)
    values = list(rng.normal(0, 0.01, n))
    got = by_asset(series.vol_scaled_momentum(series_of({"a": values}), "asset", "dt", "x", min_periods=2), "momentum")["a"]
    x = pd.Series(values)
    want = (x / x.ewm(span=22, min_periods=2).std()).rolling(230).sum().shift(22).to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-9)
    # one scaled return is missing at the start, so the first momentum is on row 253
    assert np.isfinite(got).sum() == max(0, n - 252)


def test_lag_lead_difference_count_rows_not_days(spark):
    rows = [("a", DAY0 + dtm.timedelta(days=d), float(d)) for d in (0, 1, 9, 30)]
    df = spark.createDataFrame(rows, "asset string, dt date, x double")
    df = series.lag(df, "asset", "dt", "x", 2, "l")
    df = series.lead(df, "asset", "dt", "x", 1, "f")
    df = series.difference(df, "asset", "dt", "x", "d")
    got = [(r.l, r.f, r.d) for r in df.orderBy("dt").collect()]
    assert got == [(None, 1.0, None), (None, 9.0, 1.0), (0.0, 30.0, 8.0), (1.0, None, 21.0)]


def test_cumulative_sum_is_null_at_a_null_and_goes_on(series_of):
    df = series_of({"a": [1, None, 2]})
    got = df.select("dt", series.cumulative_sum("asset", "dt", "x").alias("c")).orderBy("dt").collect()
    assert [r.c for r in got] == [1.0, None, 3.0]


def test_join_in_series_is_a_left_join(spark):
    rng = np.random.default_rng(3)
    days = [DAY0 + dtm.timedelta(days=i) for i in range(30)]
    left = [(a, d, float(rng.normal())) for a in "abc" for d in days if rng.random() < 0.6]
    right = [(a, d, None if rng.random() < 0.1 else float(rng.normal()), int(rng.integers(9)))
             for a in "abd" for d in days if rng.random() < 0.6]
    left = spark.createDataFrame(left, "asset string, dt date, z double")
    right = spark.createDataFrame(right, "asset string, dt date, p double, k int")
    got = series.join_in_series(left, right, "asset", "dt")
    want = left.join(right, ["asset", "dt"], "left")
    assert sorted(got.select(sorted(got.columns)).collect(), key=str) == sorted(
        want.select(sorted(want.columns)).collect(), key=str)
    after = series.lag(got, "asset", "dt", "p", 1, "p1")
    assert plan_of(after).count("Exchange hashpartitioning") == 1


def test_stacked_series_windows_share_one_exchange(series_of):
    plan = plan_of(series.vol_scaled_momentum(series_of({"a": [1, 2]}), "asset", "dt", "x"))
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 4  # by date, by block, by date again, by run
