"""Weights and the portfolios they make."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import known, log_growth, null_to_zero, ratio
from ..plans.sizing import join_small
from .evaluation import YEAR
from .series import cumulative_max, cumulative_sum, difference, rolling_mean

CONSTRAINTS = ("ZeroBeta", "ZeroInvestment")


def mv_weights(
    signal: DataFrame, gamma: float = 591.0, constraints: list[str] | tuple[str, ...] = (),
    max_dates: int | None = None,
) -> DataFrame:
    """Mean-variance weights per date with the specific variances as risk model: dt, asset, weight.

    Maximises w'alpha - gamma/2 * sum(risk^2 w^2), with sum(w) = 0 (``ZeroInvestment``) and/or beta'w = 0
    (``ZeroBeta``). The solution is closed-form in five sums per date. Dates with too few assets for the constraints or a
    nearly singular system have no weights and no rows, so nothing is reported for them. ``signal``: dt, asset, alpha, specific_risk, predicted_beta.
    """
    unknown = set(constraints) - set(CONSTRAINTS)
    if unknown:
        raise ValueError(f"unknown constraints {sorted(unknown)}; known: {CONSTRAINTS}")
    flat, neutral = "ZeroInvestment" in constraints, "ZeroBeta" in constraints
    alpha, beta = F.col("alpha"), F.col("predicted_beta")
    rows = signal.select("dt", "asset", "alpha", "specific_risk", *(["predicted_beta"] if neutral else []))
    for c in rows.columns:
        rows = rows.where(F.col(c).isNotNull())
    free = alpha
    precision = ratio(F.lit(1.0), F.col("specific_risk") * F.col("specific_risk"))
    if flat or neutral:
        weighted = rows.withColumn("__p", precision)
        p = F.col("__p")
        sums = [F.count(F.lit(1)).alias("__n")]
        if flat:
            sums += [F.sum(p).alias("__1"), F.sum(p * alpha).alias("__a")]
        if neutral:
            sums += [F.sum(p * beta * beta).alias("__bb"), F.sum(p * beta * alpha).alias("__ba")]
        if flat and neutral:
            sums.append(F.sum(p * beta).alias("__b"))
        per_date = weighted.groupBy("dt").agg(*sums)
        one, b, bb, a, ba = (F.col(c) for c in ("__1", "__b", "__bb", "__a", "__ba"))
        if flat and neutral:
            det = one * bb - b * b
            sound = det > one * bb * 1e-9
            shift, tilt = ratio(a * bb - ba * b, det), ratio(one * ba - b * a, det)
        elif flat:
            sound, shift, tilt = one > 0, ratio(a, one), F.lit(0.0)
        else:
            sound, shift, tilt = bb > 0, F.lit(0.0), ratio(ba, bb)
        sound = sound & (F.col("__n") > int(flat) + int(neutral) + 1)
        per_date = per_date.select(
            "dt", F.when(sound, shift).alias("__shift"), F.when(sound, tilt).alias("__tilt"))
        rows = join_small(rows, per_date, "dt", max_dates)
        free = alpha - F.col("__shift") - (F.col("__tilt") * beta if neutral else 0.0)
    found = rows.select("dt", "asset", (free * precision / float(gamma)).alias("weight"))
    return found.where(F.col("weight").isNotNull())


def _keys(df: DataFrame, by: str | None) -> list[str]:
    return [by] if by else []


def _one_series(df: DataFrame, by: str | None) -> tuple[DataFrame, str]:
    """A partition key for the windows over one row per date; a constant if there is only one strategy."""
    return (df, by) if by else (df.withColumn("__one", F.lit(0)), "__one")


def portfolio_returns(weights: DataFrame, returns: DataFrame, by: str | None = None) -> DataFrame:
    """Sum of weight times return per date (and strategy ``by``); a missing return counts 0, as does its product."""
    joined = weights.join(returns.select("dt", "asset", "ret"), ["dt", "asset"], "left")
    return joined.groupBy(*_keys(weights, by), "dt").agg(
        null_to_zero(F.sum(F.col("weight") * F.col("ret"))).alias("ret"))


def leverage(weights: DataFrame, by: str | None = None) -> DataFrame:
    """Sum of absolute weights per date."""
    return weights.groupBy(*_keys(weights, by), "dt").agg(null_to_zero(F.sum(F.abs("weight"))).alias("leverage"))


def _summary(df: DataFrame, column: str, by: str | None) -> DataFrame:
    return df.groupBy(*_keys(df, by)).agg(
        F.avg(column).alias(f"mean_{column}"), F.min(column).alias(f"min_{column}"),
        F.max(column).alias(f"max_{column}"), F.stddev_samp(column).alias(f"std_{column}"),
    )


def leverage_summary(series: DataFrame, by: str | None = None) -> DataFrame:
    return _summary(series, "leverage", by)


def drawdown(returns: DataFrame, by: str | None = None) -> DataFrame:
    """Loss since the highest point so far of the compounded return. The first date is 0.

    After a total loss it is -1 for good; from a return below -1 on it is null.
    """
    df, key = _one_series(returns, by)
    df = df.withColumn("__log", cumulative_sum(key, "dt", log_growth("ret")))
    df = df.withColumn("__peak", cumulative_max(key, "dt", "__log"))
    lost = F.col("__log") == F.lit(float("-inf"))
    fall = F.when(lost, F.lit(-1.0)).otherwise(known(F.expm1(F.col("__log") - F.col("__peak"))))
    return df.select(*_keys(returns, by), "dt", fall.alias("drawdown"))


def drawdown_summary(series: DataFrame, by: str | None = None) -> DataFrame:
    """Mean, deepest and latest drawdown, and the longest run of dates below the peak."""
    df, key = _one_series(series, by)
    window = Window.partitionBy(key).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    below = F.col("drawdown") < 0
    df = df.withColumn("__peaks", F.count_if(~below).over(window))
    runs = df.groupBy(key, "__peaks").agg(
        F.sum("drawdown").alias("__sum"), F.count("drawdown").alias("__n"), F.min("drawdown").alias("__min"),
        F.count_if(below).alias("__below"), F.max("dt").alias("__last"), F.max_by("drawdown", "dt").alias("__now"),
    )
    out = runs.groupBy(key).agg(
        ratio(F.sum("__sum"), F.sum("__n")).alias("mean_drawdown"), F.min("__min").alias("max_drawdown"),
        F.max_by("__now", "__last").alias("current_drawdown"), F.max("__below").alias("longest_drawdown"),
    )
    return out if by else out.drop(key)


def returns_summary(returns: DataFrame, by: str | None = None, periods: int = YEAR) -> DataFrame:
    """Dates, mean annual return, annual volatility, compounded total return, annual Sharpe ratio."""
    stats = returns.where(F.col("ret").isNotNull()).groupBy(*_keys(returns, by)).agg(
        F.count("ret").alias("count"), F.avg("ret").alias("__mean"), F.stddev_samp("ret").alias("__std"),
        null_to_zero(F.sum(log_growth("ret"))).alias("__log"),
    )
    return stats.select(
        *_keys(returns, by), "count", (F.col("__mean") * periods).alias("mean_annual_return"),
        (F.col("__std") * math.sqrt(periods)).alias("volatility"), known(F.expm1("__log")).alias("total_return"),
        (ratio("__mean", "__std") * math.sqrt(periods)).alias("sharpe"),
    )


def two_sided_turnover(weights: DataFrame, by: str | None = None) -> DataFrame:
    """Sum of absolute weight changes per date. An asset's first row adds 0, its disappearance adds nothing."""
    moved = difference(weights, [*_keys(weights, by), "asset"], "dt", "weight", "__diff")
    return moved.groupBy(*_keys(weights, by), "dt").agg(
        null_to_zero(F.sum(F.abs("__diff"))).alias("two_sided_turnover"))


def turnover(weights: DataFrame, window: int = YEAR, by: str | None = None) -> DataFrame:
    """Two-sided turnover averaged over the last ``window`` dates; null until there are that many."""
    df, key = _one_series(two_sided_turnover(weights, by), by)
    smooth = rolling_mean(df, key, "dt", "two_sided_turnover", window, "two_sided_turnover")
    return smooth if by else smooth.drop(key)


def turnover_summary(weights: DataFrame, by: str | None = None) -> DataFrame:
    return _summary(two_sided_turnover(weights, by), "two_sided_turnover", by)
