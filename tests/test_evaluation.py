import datetime as dtm
import math

import numpy as np
import pandas as pd
import pytest
from helpers import DAY0

from panelforge.operators import compare, evaluation as ev


@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.default_rng(21)
    rows = []
    for i in range(60):
        for a in range(12):
            if rng.random() < 0.9:
                alpha = None if rng.random() < 0.05 else float(np.round(rng.normal(), 1))
                ret = None if rng.random() < 0.05 else float(np.round(rng.normal() / 50, 2))
                rows.append((DAY0 + dtm.timedelta(days=i), f"s{a}", alpha, alpha, ret))
    return spark.createDataFrame(rows, "dt date, asset string, alpha double, signal double, ret double")


def paired(signal):
    pdf = signal.toPandas().dropna(subset=["ret"]).sort_values(["asset", "dt"])
    pdf["f"] = pdf.groupby("asset")["ret"].shift(-1)
    return pdf.dropna(subset=["alpha", "f"])


@pytest.mark.parametrize("group_rows", [3, 10_000])
@pytest.mark.parametrize("joined", [False, True])
def test_rank_ic(signal, group_rows, joined):
    returns = signal.select("dt", "asset", "ret") if joined else None
    got = ev.rank_ic(signal, returns, group_rows=group_rows).toPandas().set_index("dt")["ic"]
    want = paired(signal).groupby("dt").apply(lambda g: g["alpha"].rank().corr(g["f"].rank()), include_groups=False)
    assert set(got.index) == set(want.index)
    np.testing.assert_allclose(got.loc[want.index], want, rtol=1e-12, atol=1e-15)
    assert got.dropna().between(-1 - 1e-12, 1 + 1e-12).all()


def test_ic_of_a_constant_signal_is_null(spark):
    rows = [(DAY0 + dtm.timedelta(days=i), a, 1.0, 0.01 * i * k) for i in range(3) for k, a in enumerate("abc")]
    df = spark.createDataFrame(rows, "dt date, asset string, alpha double, ret double")
    ics = ev.rank_ic(df)
    assert {r.ic for r in ics.collect()} == {None}
    assert ev.ic_summary(ics).first() == (None, None)
    assert [r.cumulative_ic for r in ev.cumulative_ic(ics).collect()] == [0.0, 0.0]


@pytest.mark.parametrize("group_rows", [3, 10_000])
def test_quantile_portfolios(signal, group_rows):
    got = ev.quantile_portfolios(signal, 3, group_rows=group_rows).toPandas().set_index("dt").sort_index()
    pdf = paired(signal)
    rank = pdf.groupby("dt")["alpha"].rank(method="min")
    pdf["b"] = ((rank - 1) * 3 // pdf.groupby("dt")["alpha"].transform("size")).astype(int) + 1
    want = pdf.pivot_table(index="dt", columns="b", values="f", aggfunc="mean")
    want.columns = [f"p_{b}" for b in want.columns]
    want["spread"] = want["p_3"] - want["p_1"]
    want["bmk_return"] = pdf.groupby("dt")["f"].mean()
    want = want.dropna()
    assert list(got.columns) == ["p_1", "p_2", "p_3", "spread", "bmk_return"]
    assert list(got.index) == list(want.index)
    np.testing.assert_allclose(got, want[got.columns], rtol=1e-10, atol=1e-15)


def test_number_of_quantiles_is_checked(signal):
    with pytest.raises(ValueError):
        ev.quantile_portfolios(signal, 1)
    assert "p_12" in ev.quantile_portfolios(signal, 12).columns


def test_metrics(spark):
    rows = [(DAY0 + dtm.timedelta(days=i), q, r) for q, rs in {"p_1": [0.1, -0.1, None], "bmk_return": [0.1], "spread": [0.5]}.items()
            for i, r in enumerate(rs)]
    df = spark.createDataFrame(rows, "dt date, quantile string, ret double")
    got = {r.quantile: r for r in ev.portfolio_metrics(df).collect()}
    assert set(got) == {"p_1", "spread"}
    p = got["p_1"]
    assert p.n_obs == 2 and p.total_return == pytest.approx(1.1 * 0.9 - 1)
    assert p.annual_vol == pytest.approx(np.std([0.1, -0.1], ddof=1) * math.sqrt(252)) and p.sharpe_ratio == 0.0
    assert got["spread"].annual_vol is None and got["spread"].sharpe_ratio is None
    head = ev.spread_headline(ev.portfolio_metrics(df), spark.createDataFrame([(DAY0, 0.1), (DAY0, 0.3)], "dt date, ic double"))
    row = head.first()
    assert row.ic_mean == pytest.approx(0.2) and row.spread_annual_return == pytest.approx(0.5 * 252)


def test_cumulative_log_return_matches_total(spark):
    df = spark.createDataFrame([(DAY0, "p", 0.1), (DAY0 + dtm.timedelta(days=1), "p", None),
                                (DAY0 + dtm.timedelta(days=2), "p", -1.0), (DAY0 + dtm.timedelta(days=3), "p", 0.2)],
                               "dt date, quantile string, ret double")
    got = [r.cum_return for r in ev.cumulative_log_return(df).orderBy("dt").collect()]
    # nothing comes back after a total loss
    assert got[0] == pytest.approx(100 * math.log(1.1)) and got[2] == got[3] == -math.inf
    stats = ev.portfolio_metrics(df.withColumnRenamed("quantile", "q"), by="q").first()
    assert stats.total_return == -1.0 and stats.n_obs == 3


def test_returns_below_total_loss_are_undefined(spark):
    df = spark.createDataFrame([(DAY0 + dtm.timedelta(days=i), "p", r) for i, r in enumerate([0.1, -1.2, 0.2])],
                               "dt date, quantile string, ret double")
    assert [r.cum_return for r in ev.cumulative_log_return(df).orderBy("dt").collect()][1:] == [None, None]
    assert ev.portfolio_metrics(df).first().total_return is None


def test_the_return_ahead_comes_from_the_whole_panel(spark):
    def rows(days, kind):
        return spark.createDataFrame([(DAY0 + dtm.timedelta(days=d), a, float(v)) for a in ("x", "y") for d, v in days], f"dt date, asset string, {kind} double")

    panel = rows([(0, 0.01), (1, 0.02), (2, 0.03), (3, 0.04)], "ret")
    signal = rows([(0, 1.0), (3, 2.0)], "alpha")  # leaves the signal and returns
    got = ev._scored_returns(signal, "alpha", 1, panel).collect()
    assert {(r.asset, r.dt.day, r.fwd_ret) for r in got} == {("x", DAY0.day, 0.02), ("y", DAY0.day, 0.02)}


def test_sample_split(signal):
    cutoff = DAY0 + dtm.timedelta(days=20)
    parts = [ev.sample_split(signal, m, cutoff).count() for m in ("in", "out", "full")]
    assert parts[0] + parts[1] == parts[2] and parts[0] > 0
    assert ev.sample_split(signal, "in", cutoff).agg({"dt": "max"}).first()[0] == cutoff
    with pytest.raises(ValueError):
        ev.sample_split(signal, "half")
    row = ev.sample_summary(signal).first()
    assert (row.first_date, row.n_dates) == (DAY0, 60)


@pytest.mark.parametrize("accuracy", [10, 10_000])
def test_signal_stats(signal, accuracy):
    row = ev.signal_stats(signal, "signal", accuracy).first()
    x = signal.toPandas()["signal"]
    assert row["count"] == x.count() and row["null_count"] == x.isna().sum()
    assert row["mean"] == pytest.approx(x.mean()) and row["std"] == pytest.approx(x.std())
    assert [row.p25, row.p50, row.p75] == pytest.approx(list(x.quantile([0.25, 0.5, 0.75])))
    z = (x - x.mean()) / x.std(ddof=0)
    assert row["skew"] == pytest.approx((z**3).mean()) and row["kurtosis"] == pytest.approx((z**4).mean() - 3)


def test_signal_stats_set_nan_and_infinities_aside(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 4.0, None, float("nan"), float("inf"), float("-inf"))], "signal double")
    row = ev.signal_stats(df).first()
    assert (row["count"], row.null_count, row.nonfinite_count, row.min, row.p50, row.max) == (3, 1, 3, 1.0, 2.0, 4.0)
    assert row["mean"] == pytest.approx(7 / 3) and row["std"] == pytest.approx(np.std([1, 2, 4], ddof=1))


def test_histogram(signal, spark):
    x = signal.toPandas()["signal"].dropna()
    got = ev.signal_histogram(signal, bins=7).orderBy("bin").toPandas()
    want, edges = np.histogram(x, bins=7)
    assert got["count"].sum() == len(x)
    np.testing.assert_allclose(got["left"], edges[:-1])
    np.testing.assert_array_equal(got["count"], want)
    flat = spark.createDataFrame([(2.0,), (2.0,)], "signal double")
    assert ev.signal_histogram(flat, bins=4).orderBy("bin").toPandas()["count"].tolist() == [0, 0, 2, 0]
    assert ev.signal_histogram(flat.where("false"), bins=4).agg({"count": "sum"}).first()[0] == 0


def test_signal_correlation(spark):
    a = spark.createDataFrame([(DAY0, x, v) for x, v in zip("abcd", [1.0, 2.0, 3.0, 9.0])], "dt date, asset string, signal double")
    b = spark.createDataFrame([(DAY0, x, v) for x, v in zip("abce", [1.0, 3.0, 2.0, 9.0])], "dt date, asset string, signal double")
    row = compare.signal_correlation({"a": a, "b": b}).first()
    assert row.a_vs_b == pytest.approx(0.5)


def test_alignment_follows_the_base(spark):
    days = [DAY0 + dtm.timedelta(days=i) for i in range(4)]
    a = spark.createDataFrame([(d, float(i)) for i, d in enumerate(days[:3])], "dt date, ret double")
    b = spark.createDataFrame([(d, float(-i)) for i, d in enumerate(days[1:])], "dt date, ret double")
    got = compare.align_strategies({"a": a, "b": b}, "a").orderBy("dt").collect()
    assert [tuple(r) for r in got] == [(days[0], 0.0, None), (days[1], 1.0, 0.0), (days[2], 2.0, -1.0)]
    assert compare.strategy_correlation(compare.align_strategies({"a": a, "b": b}, "a")).first().a_vs_b == pytest.approx(-1.0)


def test_pandas_frame_matches_long(spark):
    wide = spark.createDataFrame(pd.DataFrame({"dt": [DAY0], "p_1": [0.1], "spread": [0.2]}))
    assert {(r.quantile, r.ret) for r in ev.portfolios_long(wide).collect()} == {("p_1", 0.1), ("spread", 0.2)}
