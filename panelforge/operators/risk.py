"""Mean-variance weights under a factor risk model, and weights within bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import ratio
from ..plans.sizing import join_small
from ..sources.staging import staged
from .crosssection import sparse_dot
from .portfolio import CONSTRAINTS
from .series import ewm_cov


def factor_covariance(
    factors: DataFrame, columns: list[str], span: int = 252, min_periods: int = 60, scale: float = 1.0,
    block_rows: int | None = None,
) -> DataFrame:
    """Exponentially weighted covariance of the factors up to each date: dt, i, j (places in ``columns``, i <= j), covariance.

    ``factors``: dt and a column per factor, one row per date. Each pair of factors is a series of its own, so the work
    spreads over k (k + 1) / 2 keys, each bounded by the calendar. ``scale`` multiplies the result (252 for a year).
    """
    rows = factors.select("dt", F.array(*[F.col(c).cast("double") for c in columns]).alias("__f"))
    rows = rows.select("dt", "__f", F.explode(F.sequence(F.lit(0), F.lit(len(columns) - 1))).alias("i"))
    rows = rows.select("dt", "__f", "i", F.explode(F.sequence(F.col("i"), F.lit(len(columns) - 1))).alias("j"))
    pairs = rows.select("dt", "i", "j", F.get("__f", F.col("i")).alias("__a"), F.get("__f", F.col("j")).alias("__b"))
    found = ewm_cov(pairs, ["i", "j"], "dt", "__a", "__b", span, min_periods, "covariance", block_rows)
    return found.select("dt", "i", "j", (F.col("covariance") * float(scale)).alias("covariance"))


def _moments(rows: DataFrame, k: int) -> DataFrame:
    """Per date the sums of z z' / risk^2 over its assets, z being the exposures, alpha, 1 and beta: dt, i <= j, total.

    Each asset adds a row for each pair of its non-zero cells; they are combined before the shuffle.
    """
    cells = F.concat(
        F.arrays_zip(F.col("at").alias("at"), F.col("share").alias("v")),
        F.array(*[F.struct(F.lit(k + n).alias("at"), F.col(c).alias("v")) for n, c in enumerate(("alpha", "__one", "__beta"))]))
    left = rows.select("dt", "__p", F.posexplode(cells).alias("__n", "__l"), cells.alias("__cells"))
    pairs = left.select("dt", "__p", "__l", F.explode(F.expr("slice(__cells, __n + 1, size(__cells))")).alias("__r"))
    total = F.sum(F.col("__p") * F.col("__l.v") * F.col("__r.v")).alias("total")
    return pairs.groupBy("dt", F.col("__l.at").alias("i"), F.col("__r.at").alias("j")).agg(total)


def _square(cells: list, n: int) -> np.ndarray:
    out = np.zeros((n, n))
    for c in cells:
        out[c["i"], c["j"]] = out[c["j"], c["i"]] = c["v"]
    return out


def _solver(k: int, held: list[int]):
    """For each date, from its moments and factor covariance: what exposures and constraints take off the alphas.

    With h = F X'w gamma and multipliers l the weights are D^-1 (alpha - A'l - X h) / gamma, and h and l solve
    (I + F M) h + F X'D^-1 A' l = F X'D^-1 alpha, A D^-1 X h + A D^-1 A' l = A D^-1 alpha, M = X'D^-1 X: a system as large
    as the number of factors, however many assets there are, and F needn't have an inverse.
    """
    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                z, f = _square(row.moments, k + 3), _square(row.covariances, k)
                x, a = slice(0, k), [k + 1 + c for c in held]
                top = np.hstack([np.eye(k) + f @ z[x, x], f @ z[x, a]])
                bottom = np.hstack([z[a, x], z[np.ix_(a, a)]])
                right = np.concatenate([f @ z[x, k], z[a, k]])
                found = np.linalg.solve(np.vstack([top, bottom]), right)
                taken = np.zeros(2)
                taken[held] = found[k:]
                out.append((row.dt, found[:k].tolist(), float(taken[0]), float(taken[1])))
            yield pd.DataFrame(out, columns=["dt", "__h", "__shift", "__tilt"])

    return solve


def factor_risk_weights(
    signal: DataFrame, exposures: DataFrame, covariance: DataFrame, k: int, gamma: float = 591.0,
    constraints: list[str] | tuple[str, ...] = (), max_dates: int | None = None,
) -> DataFrame:
    """Mean-variance weights per date with risk X F X' + diag(specific_risk^2): dt, asset, weight.

    Maximises w'alpha - gamma/2 w'(X F X' + D) w, with sum(w) = 0 (``ZeroInvestment``) and/or beta'w = 0 (``ZeroBeta``).
    ``signal``: dt, asset, alpha, specific_risk, predicted_beta; rows with a null in one that is used are left out.
    ``exposures``: ``sparse_exposures`` over ``k`` factors; an asset without a row has no exposure to any.
    ``covariance``: ``factor_covariance``; a date with a missing one, with too few assets for the constraints, or with
    betas that hardly differ has no rows. Risk and covariance must be in the same unit.

    Assets are never gathered: per date (k + 3)^2 / 2 sums, combined before the shuffle, decide all weights.
    """
    unknown = set(constraints) - set(CONSTRAINTS)
    if unknown:
        raise ValueError(f"unknown constraints {sorted(unknown)}; known: {CONSTRAINTS}")
    flat, neutral = "ZeroInvestment" in constraints, "ZeroBeta" in constraints
    used = ["alpha", "specific_risk", *(["predicted_beta"] if neutral else [])]
    rows = signal.select("dt", "asset", *used)
    for c in ("dt", "asset", *used):
        rows = rows.where(F.col(c).isNotNull())
    rows = rows.where(F.col("specific_risk") != 0).join(exposures, ["dt", "asset"], "left").select(
        "dt", "asset", "alpha", (F.col("predicted_beta") if neutral else F.lit(0.0)).alias("__beta"), F.lit(1.0).alias("__one"),
        ratio(F.lit(1.0), F.col("specific_risk") * F.col("specific_risk")).alias("__p"),
        F.coalesce("at", F.array().cast("array<int>")).alias("at"), F.coalesce("share", F.array().cast("array<double>")).alias("share"))
    rows = staged(rows)
    cell = F.struct("i", "j", "v")
    moments = _moments(rows, k).withColumnRenamed("total", "v")
    one, beta = k + 1, k + 2

    def total(i: int, j: int) -> Column:
        return F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("v")))

    packed = moments.groupBy("dt").agg(
        F.collect_list(cell).alias("moments"), total(one, one).alias("__11"), total(one, beta).alias("__1b"),
        total(beta, beta).alias("__bb"))  # (k + 3)^2 / 2 cells at most
    counts = rows.groupBy("dt").agg(F.count(F.lit(1)).alias("__n"))
    sound = F.col("__n") > int(flat) + int(neutral) + 1
    if flat and neutral:
        both = F.col("__11") * F.col("__bb")
        sound &= both - F.col("__1b") * F.col("__1b") > both * 1e-9
    elif neutral:
        sound &= F.col("__bb") > 0
    whole = k * (k + 1) // 2
    risks = covariance.where(F.col("covariance").isNotNull()).withColumnRenamed("covariance", "v").groupBy("dt").agg(
        F.collect_list(cell).alias("covariances")).where(F.size("covariances") == whole)
    held = [n for n, on in enumerate((flat, neutral)) if on]
    per_date = packed.join(counts, "dt").where(sound).join(risks, "dt").select("dt", "moments", "covariances").mapInPandas(
        _solver(k, held), "dt date, __h array<double>, __shift double, __tilt double")
    found = join_small(rows, staged(per_date), "dt", max_dates and max_dates * max(1, k // 2), "inner")
    free = F.col("alpha") - F.col("__shift") - F.col("__tilt") * F.col("__beta") - sparse_dot("at", "share", "__h")
    return found.select("dt", "asset", (free * F.col("__p") / float(gamma)).alias("weight"))


_SECTIONS = 16


def bounded_weights(
    signal: DataFrame, gamma: float = 591.0, lower: float = 0.0, upper: float = 1.0, budget: float = 1.0,
    max_dates: int | None = None,
) -> DataFrame:
    """Mean-variance weights per date with specific risks, each between ``lower`` and ``upper``, that add up to ``budget``.

    Maximises w'alpha - gamma/2 sum(risk^2 w^2): w = clip((alpha - l) / (gamma risk^2)), with one multiplier l per date.
    Returns dt, asset, weight. Rows with a null or a zero risk are left out; dates whose bounds can't add up to the
    budget have no rows.

    The multipliers of all dates are searched at once. A step splits every date's interval in ``_SECTIONS`` parts, adds up
    the weights at each cut in one aggregation, combined before the shuffle, and keeps the part where the sum passes the
    budget. Once no asset reaches or leaves a bound inside its interval a date's multiplier follows in closed form, so
    the result is exact. A date is never gathered.
    """
    if not lower <= upper:
        raise ValueError("lower is above upper")
    rows = signal.select("dt", "asset", "alpha", (F.col("specific_risk") * F.col("specific_risk") * float(gamma)).alias("__q"))
    rows = staged(rows.dropna().where((F.col("__q") > 0) & (F.abs("alpha") < F.lit(float("inf")))).withColumns({
        "__full": F.col("alpha") - F.col("__q") * upper,  # at this multiplier and below, the upper bound
        "__none": F.col("alpha") - F.col("__q") * lower}))  # at this one and above, the lower bound
    state = rows.groupBy("dt").agg(
        F.min("__full").alias("__lo"), F.max("__none").alias("__hi"), F.count(F.lit(1)).alias("__n"))
    state = staged(state.where((F.col("__n") * lower <= budget) & (F.col("__n") * upper >= budget)).drop("__n"))

    def weight(at: Column) -> Column:
        return F.least(F.greatest((F.col("alpha") - at) / F.col("__q"), F.lit(float(lower))), F.lit(float(upper)))

    def cut(s: int) -> Column:
        return F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (s / _SECTIONS)

    def inside(c: str) -> Column:
        return (F.col(c) > F.col("__lo")) & (F.col(c) < F.col("__hi"))

    done = None
    while True:
        met = join_small(rows, state, "dt", max_dates, "inner")
        sums = met.groupBy("dt", "__lo", "__hi").agg(
            F.count_if(inside("__full") | inside("__none")).alias("__open"),
            F.array(*[F.sum(weight(cut(s))) for s in range(1, _SECTIONS)]).alias("__sums"),
            F.sum(F.when(_free(), F.col("alpha") / F.col("__q"))).alias("__a"), F.sum(F.when(_free(), 1 / F.col("__q"))).alias("__1"),
            F.sum(F.when(F.col("__full") >= F.col("__hi"), F.lit(float(upper))).when(F.col("__none") <= F.col("__lo"), F.lit(float(lower)))).alias("__fixed"))
        part = F.size(F.filter("__sums", lambda x: x >= budget))  # sums fall as the multiplier rises
        width = F.col("__hi") - F.col("__lo")
        low, high = F.col("__lo") + width * part / _SECTIONS, F.col("__lo") + width * (part + 1) / _SECTIONS
        exact = ratio(F.coalesce("__a", F.lit(0.0)) + F.coalesce("__fixed", F.lit(0.0)) - budget, F.col("__1"))
        stuck = (F.col("__open") == 0) | (width <= F.greatest(F.abs("__lo"), F.abs("__hi")) * 1e-15)
        step = staged(sums.select("dt", "__open", low.alias("__low"), high.alias("__high"), stuck.alias("__done"), F.when(
            F.col("__open") == 0, F.greatest(F.least(F.coalesce(exact, F.col("__lo")), F.col("__hi")), F.col("__lo"))).otherwise(F.col("__hi")).alias("__l")))
        ended = step.where("__done").select("dt", "__l")
        done = ended if done is None else done.unionByName(ended)
        state = step.where("not __done").select("dt", F.col("__low").alias("__lo"), F.col("__high").alias("__hi"))
        if state.isEmpty():
            break
    found = join_small(rows, staged(done), "dt", max_dates, "inner")
    return found.select("dt", "asset", weight(F.col("__l")).alias("weight"))


def _free() -> Column:
    """Assets between their bounds over the whole interval of the multiplier."""
    return (F.col("__full") <= F.col("__lo")) & (F.col("__none") >= F.col("__hi"))
