"""Evaluation of a signal: samples, distribution, quantile portfolios, information coefficients."""

from __future__ import annotations

import datetime as dtm
import math

from pyspark.sql import DataFrame, functions as F

from ..functions import correlation, drop_null_rows, known, log_growth, null_to_zero, ratio
from ..plans.sizing import GROUP_ROWS, largest_group
from ..sources.staging import staged
from .crosssection import unpivot
from .ranking import average_rank, exact_percentiles, quantile_bucket, rank_counts
from .series import cumulative_sum, lead

YEAR = 252
"""Trading days per year."""

CUTOFF = dtm.date(2018, 1, 1)


def sample_split(df: DataFrame, mode: str = "full", cutoff: dtm.date = CUTOFF, date: str = "dt") -> DataFrame:
    """``in``: dates up to the cutoff; ``out``: dates after it; ``full``: all."""
    if mode == "full":
        return df
    if mode == "in":
        return df.where(F.col(date) <= F.lit(cutoff))
    if mode == "out":
        return df.where(F.col(date) > F.lit(cutoff))
    raise ValueError(f"mode must be 'full', 'in' or 'out', not {mode!r}")


def sample_summary(df: DataFrame, date: str = "dt") -> DataFrame:
    """First date, last date, number of dates."""
    days = df.groupBy(date).agg(F.lit(1).alias("one"))
    return days.agg(
        F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count(date).alias("n_dates"),
    )


def signal_stats(df: DataFrame, column: str = "signal", accuracy: int = 10_000) -> DataFrame:
    """One row: count, nulls, NaN and infinite values, and of the others mean, std, min, quartiles, max, skewness, excess
    kurtosis. Read three times, one column each; ``accuracy`` as in ``exact_percentiles``."""
    c = F.col(column)
    finite = F.when(F.abs(c) < F.lit(float("inf")), c)
    moments = df.agg(
        F.count(finite).alias("count"), F.count_if(c.isNull()).alias("null_count"),
        F.count_if(c.isNotNull() & finite.isNull()).alias("nonfinite_count"), F.avg(finite).alias("mean"),
        F.stddev_samp(finite).alias("std"), F.min(finite).alias("min"), F.max(finite).alias("max"), F.skewness(finite).alias("skew"),
        F.kurtosis(finite).alias("kurtosis"),
    )
    names = ["p25", "p50", "p75"]
    quartiles = exact_percentiles(df, column, [0.25, 0.5, 0.75], names, accuracy)
    both = moments.withColumn("__k", F.lit(1)).join(quartiles.withColumn("__k", F.lit(1)), "__k")
    return both.select("count", "null_count", "nonfinite_count", "mean", "std", "min", *names, "max", "skew", "kurtosis")


def signal_histogram(df: DataFrame, column: str = "signal", bins: int = 50) -> DataFrame:
    """Counts in ``bins`` equal-width bins from minimum to maximum; the last bin includes the maximum. Empty bins
    are listed with 0. Equal values give bins half a unit to each side, no values bins from 0 to 1. Nulls, NaN and
    infinities are left out."""
    values = df.where(F.abs(F.col(column)) < F.lit(float("inf"))).select(F.col(column).alias("__v"))
    low, high = values.agg(F.min("__v"), F.max("__v")).first()
    if low is None:
        low, high = 0.0, 1.0
    if low == high:
        low, high = low - 0.5, high + 0.5
    place = F.floor((F.col("__v") - F.lit(low)) / F.lit(high - low) * bins)
    counts = values.groupBy(F.least(place, F.lit(bins - 1).cast("long")).alias("id")).agg(
        F.count(F.lit(1)).alias("count"))
    width = (high - low) / bins
    edges = df.sparkSession.range(bins).select(
        "id", (F.lit(low) + F.col("id") * width).alias("left"), (F.lit(low) + (F.col("id") + 1) * width).alias("right"))
    return edges.join(counts, "id", "left").select(
        F.col("id").alias("bin"), "left", "right", F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def forward_return(returns: DataFrame, horizon: int = 1, out: str = "fwd_ret") -> DataFrame:
    """Return ``horizon`` rows ahead for each asset; 0 is the return of the same row. Null returns are left out
    first."""
    known = returns.where(F.col("ret").isNotNull())
    if horizon == 0:
        return known.withColumn(out, F.col("ret"))
    return lead(known, "asset", "dt", "ret", horizon, out)


def _scored_returns(signal: DataFrame, column: str, horizon: int, returns: DataFrame | None = None) -> DataFrame:
    """Rows with both a signal and a later return, the asset's next one in ``returns`` if given."""
    if returns is not None:
        later = forward_return(returns.select("dt", "asset", "ret"), horizon).where(F.col("fwd_ret").isNotNull())
        both = signal.where(F.col(column).isNotNull()).select("dt", "asset", column)
        return both.join(later.select("dt", "asset", "fwd_ret"), ["dt", "asset"])
    rows = forward_return(signal.select("dt", "asset", column, "ret"), horizon)
    rows = rows.where(F.col(column).isNotNull() & F.col("fwd_ret").isNotNull())
    return rows.select("dt", "asset", column, "fwd_ret")


def _date_size(signal: DataFrame, column: str) -> int:
    """Rows of the date with most signals, an upper bound for the ranked rows of a date."""
    return largest_group(signal.where(F.col(column).isNotNull()), ["dt"])


def quantile_portfolios(
    signal: DataFrame, n: int = 5, column: str = "alpha", horizon: int = 1, group_rows: int = GROUP_ROWS,
    returns: DataFrame | None = None,
) -> DataFrame:
    """Equal-weight return per date of ``n`` signal buckets: dt, p_1..p_n, spread (p_n - p_1), bmk_return (all).

    Dates where a bucket is empty are dropped. ``returns`` (dt, asset, ret) is the whole panel; without it the signal
    table's own rows are led over, which is the same only if it holds every date of an asset.
    """
    if n < 2:
        raise ValueError("n starts at 2")
    largest = _date_size(signal, column)
    rows = _scored_returns(signal, column, horizon, returns)
    rows = staged(rows) if largest > group_rows else rows
    ranked = rank_counts(rows, ["dt"], column, "r", group_rows, largest)
    bucket = ranked.withColumn("__bucket", quantile_bucket("r", n))
    sums = bucket.groupBy("dt", "__bucket").agg(F.sum("fwd_ret").alias("__sum"), F.count("fwd_ret").alias("__rows"))
    mean = [
        ratio(F.sum(F.when(F.col("__bucket") == b, F.col("__sum"))), F.sum(F.when(F.col("__bucket") == b, F.col("__rows"))))
        .alias(f"p_{b}")
        for b in range(1, n + 1)
    ]
    wide = sums.groupBy("dt").agg(*mean, ratio(F.sum("__sum"), F.sum("__rows")).alias("bmk_return"))
    wide = wide.withColumn("spread", F.col(f"p_{n}") - F.col("p_1"))
    return drop_null_rows(wide.select("dt", *[f"p_{b}" for b in range(1, n + 1)], "spread", "bmk_return"))


def portfolios_long(wide: DataFrame) -> DataFrame:
    """dt, quantile, ret: one row per date and portfolio."""
    return unpivot(wide, ["dt"], None, "quantile", "ret")


def cumulative_log_return(returns: DataFrame, by: str = "quantile", scale: float = 100.0) -> DataFrame:
    """Running sum of log(1 + ret) by date, times ``scale``, for each portfolio (one row per date and portfolio).

    From a total loss on it is -Infinity, from a return below -1 on it is null.
    """
    total = cumulative_sum(by, "dt", log_growth("ret")) * scale
    return returns.select("dt", by, known(total).alias("cum_return"))


def portfolio_metrics(long: DataFrame, by: str = "quantile", periods: int = YEAR, benchmark: str = "bmk_return") -> DataFrame:
    """Per portfolio other than the benchmark: annual return and volatility, Sharpe ratio per period
    (``sharpe_ratio``) and per year (``sharpe_annual``), compounded total return, observations."""
    stats = (
        long.where(F.col("ret").isNotNull() & (F.col(by) != benchmark))
        .groupBy(by)
        .agg(
            F.avg("ret").alias("__mean"), F.stddev_samp("ret").alias("__std"),
            null_to_zero(F.sum(log_growth("ret"))).alias("__log"), F.count("ret").alias("n_obs"),
        )
    )
    return stats.select(
        by,
        (F.col("__mean") * periods).alias("annual_return"),
        (F.col("__std") * math.sqrt(periods)).alias("annual_vol"),
        ratio("__mean", "__std").alias("sharpe_ratio"),
        (ratio("__mean", "__std") * math.sqrt(periods)).alias("sharpe_annual"),
        known(F.expm1("__log")).alias("total_return"),
        "n_obs",
    )


def rank_ic(
    alphas: DataFrame, returns: DataFrame | None = None, horizon: int = 1, column: str = "alpha",
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Rank correlation per date of a signal with the return ``horizon`` rows later: dt, ic.

    Without ``returns`` they are read from the signal table, which saves the join. Null signals and null returns are
    left out; a date with a constant side has a null ic.
    """
    rows = _scored_returns(alphas, column, horizon, returns)
    largest = _date_size(alphas, column)
    rows = staged(rows) if largest > group_rows else rows
    ranked = rank_counts(rows, ["dt"], column, "a", group_rows, largest)
    ranked = staged(ranked) if largest > group_rows else ranked
    ranked = rank_counts(ranked, ["dt"], "fwd_ret", "f", group_rows, largest)
    middle = (F.col("a_n") + 1) / 2
    moved = ranked.select("dt", (average_rank("a") - middle).alias("__a"), (average_rank("f") - middle).alias("__f"))
    sums = moved.groupBy("dt").agg(
        F.sum(F.col("__a") * F.col("__f")).alias("__af"), F.sum(F.col("__a") * F.col("__a")).alias("__aa"),
        F.sum(F.col("__f") * F.col("__f")).alias("__ff"),
    )
    return sums.select("dt", ratio("__af", F.sqrt(F.col("__aa")) * F.sqrt(F.col("__ff"))).alias("ic"))


def ic_summary(ics: DataFrame) -> DataFrame:
    """One row: mean ic and mean / deviation."""
    return ics.agg(F.avg("ic").alias("ic_mean"), ratio(F.avg("ic"), F.stddev_samp("ic")).alias("ic_ir"))


def cumulative_ic(ics: DataFrame, by: str | None = None) -> DataFrame:
    """Running sum of ic by date, null counted as 0. One row per date (and ``by``)."""
    keyed = ics if by else ics.withColumn("__one", F.lit(0))
    total = cumulative_sum(by or "__one", "dt", null_to_zero("ic"))
    return keyed.select("dt", *([by] if by else []), "ic", total.alias("cumulative_ic"))


def spread_headline(metrics: DataFrame, ics: DataFrame, by: str = "quantile") -> DataFrame:
    """One row: Sharpe ratio and annual return of the spread, mean ic, ic ratio."""
    spread = metrics.where(F.col(by) == "spread").select(
        F.lit(1).alias("__k"), F.col("sharpe_ratio").alias("spread_sharpe"),
        F.col("annual_return").alias("spread_annual_return"),
    )
    summary = ic_summary(ics).withColumn("__k", F.lit(1))
    return spread.join(F.broadcast(summary), "__k").drop("__k")


def signal_correlation(signals: dict[str, DataFrame], column: str = "signal") -> DataFrame:
    """One row with the correlation of each pair of signals over their common assets and dates, ``a_vs_b``."""
    long = None
    for name, df in signals.items():
        part = df.select("dt", "asset", F.lit(name).alias("strategy"), F.col(column).alias("__s"))
        long = part if long is None else long.unionByName(part)
    names = list(signals)
    wide = long.groupBy("dt", "asset").agg(*[F.max(F.when(F.col("strategy") == n, F.col("__s"))).alias(n) for n in names])
    return pairwise_correlation(wide, names)


def pairwise_correlation(wide: DataFrame, names: list[str]) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    return wide.agg(*[correlation(a, b).alias(f"{a}_vs_{b}") for a, b in pairs])
