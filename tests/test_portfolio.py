import datetime as dtm
import math

import numpy as np
import pandas as pd
import pytest
from helpers import DAY0

from panelforge.operators import portfolio as pf
from panelforge.operators.regression import factor_regression


def days(n):
    return [DAY0 + dtm.timedelta(days=i) for i in range(n)]


@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.default_rng(4)
    rows = [(d, f"s{a}", float(rng.normal()), float(rng.uniform(5, 40)), float(rng.uniform(0.3, 1.7)))
            for d in days(5) for a in range(10)]
    rows += [(days(6)[5], f"s{a}", 0.1 * a, 10.0, 1.0) for a in range(3)]
    return spark.createDataFrame(rows, "dt date, asset string, alpha double, specific_risk double, predicted_beta double")


@pytest.mark.parametrize("constraints", [(), ("ZeroInvestment",), ("ZeroBeta",), ("ZeroInvestment", "ZeroBeta")])
@pytest.mark.parametrize("max_dates", [None, 6])
def test_weights_solve_the_first_order_conditions(signal, constraints, max_dates):
    gamma = 50.0
    w = pf.mv_weights(signal, gamma, constraints, max_dates).toPandas()
    both = w.merge(signal.toPandas(), on=["dt", "asset"])
    undetermined = 3 if len(constraints) == 2 else 0  # the last date
    assert len(both) == 53 - undetermined
    for _, g in both[both["dt"] < days(6)[5]].groupby("dt"):
        rows = {"ZeroInvestment": np.ones(len(g)), "ZeroBeta": g["predicted_beta"].to_numpy()}
        c = np.array([rows[n] for n in constraints]).reshape(len(constraints), len(g))
        kkt = np.block([[np.diag(gamma * g["specific_risk"] ** 2), c.T], [c, np.zeros((len(c), len(c)))]])
        want = np.linalg.solve(kkt, np.concatenate([g["alpha"], np.zeros(len(c))]))[: len(g)]
        np.testing.assert_allclose(g["weight"], want, rtol=1e-8, atol=1e-14)
        assert np.abs(c @ g["weight"]).max(initial=0) < 1e-15


def test_no_weights_where_they_are_not_determined(signal):
    last = days(6)[5]
    w = pf.mv_weights(signal, 591, ("ZeroInvestment", "ZeroBeta")).where(f"dt = date'{last}'").collect()
    assert not w
    with pytest.raises(ValueError):
        pf.mv_weights(signal, 591, ["LongOnly"])


@pytest.fixture(scope="module")
def weights(spark):
    d = days(4)
    rows = [(d[0], "a", 1.0), (d[0], "b", -1.0), (d[1], "a", 0.5), (d[1], "b", -0.5), (d[1], "c", 0.25),
            (d[2], "a", 0.5), (d[3], "a", None), (d[3], "z", None)]
    return spark.createDataFrame(rows, "dt date, asset string, weight double")


def test_portfolio_returns(spark, weights):
    d = days(4)
    returns = spark.createDataFrame([(d[0], "a", 0.1), (d[0], "b", 0.2), (d[1], "a", 0.1)], "dt date, asset string, ret double")
    got = [r.ret for r in pf.portfolio_returns(weights, returns).orderBy("dt").collect()]
    assert got == pytest.approx([-0.1, 0.05, 0.0, 0.0])


def test_leverage(weights):
    got = pf.leverage(weights)
    assert [r.leverage for r in got.orderBy("dt").collect()] == [2.0, 1.25, 0.5, 0.0]
    row = pf.leverage_summary(got).first()
    assert (row.min_leverage, row.max_leverage) == (0.0, 2.0) and row.mean_leverage == pytest.approx(3.75 / 4)


def test_turnover_ignores_entry_and_exit(weights):
    got = [r.two_sided_turnover for r in pf.two_sided_turnover(weights).orderBy("dt").collect()]
    assert got == [0.0, 1.0, 0.0, 0.0]
    smooth = [r.two_sided_turnover for r in pf.turnover(weights, 2).orderBy("dt").collect()]
    assert smooth == [None, 0.5, 0.5, 0.0]
    assert pf.turnover_summary(weights).first().max_two_sided_turnover == 1.0


def test_turnover_against_pandas(spark):
    rng = np.random.default_rng(8)
    rows = [(d, f"s{a}", float(rng.normal())) for d in days(40) for a in range(6) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "dt date, asset string, weight double")
    pdf = df.toPandas().sort_values(["asset", "dt"])
    pdf["c"] = pdf.groupby("asset")["weight"].diff().abs()
    want = pdf.groupby("dt")["c"].sum().rolling(10).mean()
    got = pf.turnover(df, 10).toPandas().set_index("dt")["two_sided_turnover"].sort_index()
    np.testing.assert_allclose(got, want, rtol=1e-12)


def test_drawdown_starts_at_zero_even_after_a_loss(spark):
    rets = [-0.5, 0.1, -0.2, -0.1, 1.0, 0.0, -0.3]
    df = spark.createDataFrame(list(zip(days(7), rets)), "dt date, ret double")
    value = np.cumprod(1 + np.array(rets))
    want = value / np.maximum.accumulate(value) - 1
    got = pf.drawdown(df)
    series = [r.drawdown for r in got.orderBy("dt").collect()]
    assert series[0] == 0.0 and max(series) <= 0.0
    np.testing.assert_allclose(series, want, atol=1e-12)
    row = pf.drawdown_summary(got).first()
    assert row.longest_drawdown == 2 and row.max_drawdown == pytest.approx(want.min())
    assert row.mean_drawdown == pytest.approx(want.mean()) and row.current_drawdown == pytest.approx(-0.3)


def test_longest_drawdown_against_a_loop(spark):
    rng = np.random.default_rng(12)
    rets = {s: rng.normal(0, 0.02, 300) for s in ("x", "y")}
    rows = [(s, d, float(r)) for s, rs in rets.items() for d, r in zip(days(300), rs)]
    df = spark.createDataFrame(rows, "strategy string, dt date, ret double")
    got = {r.strategy: r.longest_drawdown for r in pf.drawdown_summary(pf.drawdown(df, "strategy"), "strategy").collect()}
    for s, rs in rets.items():
        value = np.cumsum(np.log1p(rs))
        best = run = 0
        for below in value < np.maximum.accumulate(value):
            run = run + 1 if below else 0
            best = max(best, run)
        assert got[s] == best


def test_returns_summary(spark):
    df = spark.createDataFrame([(days(3)[i], "s", r) for i, r in enumerate([0.01, 0.02, None])], "dt date, strategy string, ret double")
    row = pf.returns_summary(df, "strategy").first()
    assert row["count"] == 2 and row.total_return == pytest.approx(1.01 * 1.02 - 1)
    assert row.sharpe == pytest.approx(0.015 / np.std([0.01, 0.02], ddof=1) * math.sqrt(252))


def test_regression_against_numpy(spark):
    rng = np.random.default_rng(9)
    n = 120
    x = rng.normal(size=(n, 3)) * 0.01 + 0.02
    frames, want = [], {}
    for name in ("p_1", "p_2"):
        y = 0.001 + x @ rng.normal(size=3) + rng.normal(size=n) * 0.002
        frames.append(pd.DataFrame({"dt": days(n), "quantile": name, "ret": y}))
        a = np.column_stack([np.ones(n), x])
        b, rss, *_ = np.linalg.lstsq(a, y, rcond=None)
        se = np.sqrt(rss[0] / (n - 4) * np.diag(np.linalg.inv(a.T @ a)))
        want[name] = (b, se, 1 - rss[0] / ((y - y.mean()) ** 2).sum())
    factors = spark.createDataFrame(pd.DataFrame({"dt": days(n), "mktrf": x[:, 0], "smb": x[:, 1], "hml": x[:, 2]}))
    got = factor_regression(spark.createDataFrame(pd.concat(frames)), factors, by="quantile").toPandas()
    for name, (b, se, r2) in want.items():
        g = got[got["quantile"] == name].set_index("term").loc[["intercept", "mktrf", "smb", "hml"]]
        np.testing.assert_allclose(g["coefficient"], b, rtol=1e-8)
        np.testing.assert_allclose(g["std_error"], se, rtol=1e-8)
        np.testing.assert_allclose(g["t_stat"], b / se, rtol=1e-8)
        assert g["r_squared"].iloc[0] == pytest.approx(r2) and g["n_obs"].iloc[0] == n
        assert g["annualised"].iloc[0] == pytest.approx(252 * b[0]) and g["annualised"].iloc[1:].isna().all()


def test_regression_without_enough_dates_or_variation(spark):
    rows = [(d, 0.1, 0.2, 0.3, 0.4) for d in days(10)]
    df = spark.createDataFrame(rows, "dt date, ret double, mktrf double, smb double, hml double")
    got = factor_regression(df.select("dt", "ret"), df.drop("ret")).collect()
    assert len(got) == 4 and all(r.coefficient is None and r.n_obs == 10 for r in got)
    few = factor_regression(df.select("dt", "ret").limit(3), df.drop("ret")).collect()
    assert all(r.coefficient is None for r in few)
    assert factor_regression(df.select("dt", "ret").where("false"), df.drop("ret")).collect() == []
