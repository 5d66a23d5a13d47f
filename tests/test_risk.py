"""Factor covariances, weights under a factor risk model and within bounds."""

import datetime as dtm

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import DAY0, plan_of
from panelforge.operators import crosssection as cs, risk
from panelforge.operators.portfolio import mv_weights

COLUMNS = ["f0", "f1", "f2", "f3"]
DATES = [DAY0 + dtm.timedelta(days=i) for i in range(12)]


@pytest.fixture(scope="module")
def factors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(len(DATES), 4)) @ rng.normal(size=(4, 4))
    x[:, 3] = x[:, 0] - 2 * x[:, 1]  # a covariance without inverse
    rows = [(d, *map(float, r)) for d, r in zip(DATES, x)]
    return spark.createDataFrame(rows, "dt date, f0 double, f1 double, f2 double, f3 double"), x


@pytest.fixture(scope="module")
def market(spark):
    rng = np.random.default_rng(1)
    signal, flags = [], []
    for d in DATES:
        for a in range(25):
            signal.append((d, f"a{a}", float(rng.normal()), float(rng.uniform(1, 3)), float(rng.uniform(0.5, 1.5))))
            if a % 6:
                flags.append((d, f"a{a}", *[float(v) if v else None for v in rng.integers(0, 2, 4)]))
    df = spark.createDataFrame(signal, "dt date, asset string, alpha double, specific_risk double, predicted_beta double")
    return df, spark.createDataFrame(flags, "dt date, asset string, f0 double, f1 double, f2 double, f3 double")


@pytest.mark.parametrize("block_rows", [None, 3])
def test_covariance_equals_pandas(factors, block_rows):
    df, x = factors
    got = risk.factor_covariance(df, COLUMNS, 5, 4, 252.0, block_rows).toPandas()
    want = pd.DataFrame(x).ewm(span=5, min_periods=4).cov(bias=False) * 252
    assert len(got) == 10 * len(DATES) and got[got.dt < DATES[3]].covariance.isna().all()
    for r in got[got.dt >= DATES[3]].itertuples():
        assert r.covariance == pytest.approx(want.loc[DATES.index(r.dt), r.i][r.j], abs=1e-9)


def test_covariance_skips_nulls(spark):
    x = pd.DataFrame({"f0": [1.0, 2.0, None, 4.0, 3.0], "f1": [2.0, None, 1.0, 5.0, 4.0]})
    rows = [(d, *[None if pd.isna(v) else float(v) for v in r]) for d, r in zip(DATES, x.to_numpy())]
    got = risk.factor_covariance(spark.createDataFrame(rows, "dt date, f0 double, f1 double"), ["f0", "f1"], 3, 2)
    want = x.ewm(span=3, min_periods=2).cov()
    found = {(r.dt, r.i, r.j): r.covariance for r in got.collect()}
    assert found[DATES[3], 0, 1] == pytest.approx(want.loc[3, "f0"]["f1"]) and found[DATES[2], 0, 1] is None


@pytest.mark.parametrize("constraints", [(), ("ZeroInvestment",), ("ZeroBeta",), ("ZeroInvestment", "ZeroBeta")])
def test_weights_equal_a_dense_solve(factors, market, constraints):
    signal, flags = market
    covariance = risk.factor_covariance(factors[0], COLUMNS, 5, 4)
    sparse = cs.sparse_exposures(flags, COLUMNS)
    got = risk.factor_risk_weights(signal, sparse, covariance, 4, 50.0, constraints, len(DATES)).toPandas().set_index(["dt", "asset"]).weight
    cov = {(r.dt, r.i, r.j): r.covariance for r in covariance.collect()}
    shares = {(r.dt, r.asset): np.bincount(r["at"], r.share, 4) for r in sparse.collect() if r["at"]}
    rows = signal.toPandas()
    assert set(got.index.get_level_values(0)) == set(DATES[3:])
    for d, day in rows[rows.dt.isin(DATES[3:])].groupby("dt"):
        f = np.array([[cov[d, min(i, j), max(i, j)] for j in range(4)] for i in range(4)])
        x = np.array([shares.get((d, a), np.zeros(4)) for a in day.asset])
        sigma = x @ f @ x.T + np.diag(day.specific_risk.to_numpy() ** 2)
        held = np.array([v for n, v in (("ZeroInvestment", np.ones(len(day))), ("ZeroBeta", day.predicted_beta.to_numpy())) if n in constraints]).reshape(-1, len(day))
        m = len(held)
        kkt = np.block([[50.0 * sigma, held.T], [held, np.zeros((m, m))]])
        want = np.linalg.solve(kkt, np.concatenate([day.alpha, np.zeros(m)]))[:len(day)]
        w = np.array([got[d, a] for a in day.asset])
        assert np.abs(w - want).max() < 1e-9 and (np.abs(held @ w) < 1e-12).all()


def test_no_factors_is_specific_risk_alone(factors, market):
    signal, flags = market
    covariance = risk.factor_covariance(factors[0], COLUMNS, 5, 2)
    got = risk.factor_risk_weights(signal, cs.sparse_exposures(flags.where("false"), COLUMNS), covariance, 4, 591, ("ZeroBeta",))
    want = mv_weights(signal, 591, ("ZeroBeta",)).where(F.col("dt") > DATES[0])
    a, b = (df.orderBy("dt", "asset").toPandas() for df in (got, want))
    assert (a.asset == b.asset).all() and np.allclose(a.weight, b.weight, atol=1e-12)


def test_dates_that_decide_nothing_have_no_rows(factors, market):
    signal, flags = market
    covariance = risk.factor_covariance(factors[0], COLUMNS, 5, 2)
    few = signal.where(F.col("asset").isin("a1", "a2", "a3"))
    sparse = cs.sparse_exposures(flags, COLUMNS)
    assert risk.factor_risk_weights(few, sparse, covariance, 4, 1, ("ZeroInvestment", "ZeroBeta")).count() == 0
    alike = signal.withColumn("predicted_beta", F.lit(1.0))
    assert risk.factor_risk_weights(alike, sparse, covariance, 4, 1, ("ZeroInvestment", "ZeroBeta")).count() == 0
    with pytest.raises(ValueError):
        risk.factor_risk_weights(signal, sparse, covariance, 4, 1, ("Long",))


def check_optimal(day, w, gamma, lower, upper, budget):
    assert w.sum() == pytest.approx(budget, abs=1e-12) and (w >= lower - 1e-15).all() and (w <= upper + 1e-15).all()
    slope = day.alpha.to_numpy() - gamma * day.specific_risk.to_numpy() ** 2 * w
    free = (w > lower + 1e-12) & (w < upper - 1e-12)
    level = slope[free].mean() if free.any() else None
    if level is not None:
        assert np.abs(slope[free] - level).max() < 1e-9
        assert (slope[w <= lower + 1e-12] <= level + 1e-9).all() and (slope[w >= upper - 1e-12] >= level - 1e-9).all()
    else:
        assert slope[w <= lower + 1e-12].max(initial=-np.inf) <= slope[w >= upper - 1e-12].min(initial=np.inf) + 1e-9


@pytest.mark.parametrize("gamma, lower, upper, budget", [(2.0, 0.0, 0.1, 1.0), (0.01, 0.0, 0.04, 1.0), (50.0, 0.0, 1.0, 1.0), (1.0, -0.05, 0.08, 0.0), (1.0, 0.02, 0.3, 0.5)])
def test_bounded_weights_are_optimal(market, gamma, lower, upper, budget):
    signal = market[0]
    got = risk.bounded_weights(signal, gamma, lower, upper, budget, len(DATES)).toPandas().set_index(["dt", "asset"]).weight
    assert len(got) == 25 * len(DATES)
    for d, day in signal.toPandas().groupby("dt"):
        check_optimal(day, np.array([got[d, a] for a in day.asset]), gamma, lower, upper, budget)


def test_bounded_weights_odd_rows(spark):
    rows = [(DATES[0], "a", 1.0, 1.0), (DATES[0], "b", 1.0, 1.0), (DATES[0], "c", None, 1.0), (DATES[0], "d", 9.0, 0.0),
            (DATES[1], "a", 1.0, 1.0), (DATES[2], "a", 5.0, 2.0), (DATES[2], "b", 5.0, 2.0), (DATES[2], "c", 5.0, 2.0)]
    df = spark.createDataFrame(rows, "dt date, asset string, alpha double, specific_risk double")
    got = {(r.dt, r.asset): r.weight for r in risk.bounded_weights(df, 1.0, 0.0, 0.5).collect()}
    assert got == pytest.approx({(DATES[0], "a"): 0.5, (DATES[0], "b"): 0.5, **{(DATES[2], x): 1 / 3 for x in "abc"}})
    assert risk.bounded_weights(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        risk.bounded_weights(df, 1.0, 1.0, 0.5)


def test_sparse_exposures(market, factors):
    flags = market[1]
    wide = cs.exposure_shares(flags, COLUMNS).collect()
    sparse = {(r.dt, r.asset): dict(zip(r["at"], r.share)) for r in cs.sparse_exposures(flags, COLUMNS).collect()}
    for r in wide:
        assert sparse[r.dt, r.asset] == {i: r[c] for i, c in enumerate(COLUMNS) if r[c] > 0 and not np.isnan(r[c])}
    none = sum(not cells for cells in sparse.values())
    assert none and cs.sparse_exposures(flags, COLUMNS, "drop").count() == len(sparse) - none
    momentum = cs.unpivot(factors[0], ["dt"], COLUMNS, "industry", "momentum").where("industry <> 'f2'")
    a = cs.project_exposures_sparse(cs.sparse_exposures(flags, COLUMNS), momentum, COLUMNS, len(DATES))
    b = cs.project_exposures(cs.normalise_exposures(flags, COLUMNS), momentum)
    x, y = ({(r.dt, r.asset): r.momentum_score for r in df.collect()} for df in (a, b))
    assert x == pytest.approx(y, abs=1e-12)
    assert "Exchange hashpartitioning(dt" not in plan_of(cs.project_exposures_sparse(cs.sparse_exposures(flags, COLUMNS), momentum, COLUMNS, 5)).split("BroadcastExchange")[0]
