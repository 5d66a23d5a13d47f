"""Time-series operators: one series per key, one row per key and date, steps are observed rows.

All windows partition by the series key (or refine it), so a stack of these operators needs one exchange.
A series holds at most one row per date, so its length is bounded by the calendar.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import ratio
from ..plans.sizing import by_series

_LOG_RANGE = 640.0
"""Exponent range kept free of overflow: exp(640) squared weights still fit a double."""


def _window(key, order: str):
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(order)


def _so_far(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def lag(df: DataFrame, key, order: str, value: str, steps: int, out: str) -> DataFrame:
    """Value ``steps`` rows earlier in the series."""
    return df.withColumn(out, F.lag(value, steps).over(_window(key, order)))


def lead(df: DataFrame, key, order: str, value: str, steps: int, out: str) -> DataFrame:
    """Value ``steps`` rows later in the series."""
    return df.withColumn(out, F.lead(value, steps).over(_window(key, order)))


def difference(df: DataFrame, key, order: str, value: str, out: str) -> DataFrame:
    """Change from the previous row of the series; null on the first."""
    return df.withColumn(out, F.col(value) - F.lag(value).over(_window(key, order)))


def join_in_series(left: DataFrame, right: DataFrame, key: str, order: str, max_rows: int | None = None) -> DataFrame:
    """Left join of two panels on (key, order), both one row per pair, that leaves each series in one partition.

    The rows of both panels are interleaved by one exchange on ``key`` and the values taken from the row just before,
    so windows over the series that follow need no further exchange, as they would after a join on both columns.
    ``max_rows`` bounds the rows of both; the series are then dealt by it (``by_series``).
    """
    added = [c for c in right.columns if c not in (key, order)]
    types = dict(right.dtypes)
    above = left.select("*", *[F.lit(None).cast(types[c]).alias(c) for c in added], F.lit(1).alias("__side"))
    rows = above.unionByName(right.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    rows = by_series(rows, max_rows, key)
    w = Window.partitionBy(key).orderBy(order, "__side")
    match = (F.lag("__side").over(w) == 0) & (F.lag(order).over(w) == F.col(order))
    rows = rows.withColumns({c: F.when(match, F.lag(c).over(w)) for c in added})
    return rows.where(F.col("__side") == 1).drop("__side")


def cumulative_sum(key, order: str, value: str | Column) -> Column:
    """Running sum that is null where the value is null and carries on after it."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value.isNotNull(), F.sum(value).over(_so_far(_window(key, order))))


def cumulative_max(key, order: str, value: str) -> Column:
    return F.max(value).over(_so_far(_window(key, order)))


def _rolled(df: DataFrame, key, order: str, value: str, window: int, out: str) -> DataFrame:
    """``rolling_sum`` that keeps ``__run``, the number of the run of ``window`` rows each row is in."""
    w = _window(key, order)
    keys = [key] if isinstance(key, str) else list(key)
    in_run = _so_far(Window.partitionBy(*keys, "__run").orderBy(order))
    # runs follow the dates, so this is the order of the series again, and the one the rows are sorted in by then
    by_run = Window.partitionBy(*keys).orderBy("__run", order)
    df = df.withColumns({"__row": F.row_number().over(w) - 1, "__seen": F.count(value).over(_so_far(w))})
    df = df.withColumns({"__run": F.floor(F.col("__row") / window), "__pos": F.col("__row") % window})
    df = df.withColumn("__head", F.coalesce(F.sum(value).over(in_run), F.lit(0.0)))
    closing = F.when(F.col("__pos") == window - 1, F.col("__head"))
    df = df.withColumns({
        "__seen0": F.coalesce(F.lag("__seen", window).over(by_run), F.lit(0)),
        "__head0": F.lag("__head", window).over(by_run),
        "__run0": F.last(closing, ignorenulls=True).over(by_run.rowsBetween(Window.unboundedPreceding, -1)),
    })
    tail = F.when(F.col("__pos") < window - 1, F.col("__run0") - F.col("__head0")).otherwise(F.lit(0.0))
    full = F.col("__seen") - F.col("__seen0") == window
    return df.withColumn(out, F.when(full, F.col("__head") + tail)).drop(
        "__row", "__seen", "__pos", "__head", "__seen0", "__head0", "__run0")


def rolling_sum(df: DataFrame, key, order: str, value: str, window: int, out: str) -> DataFrame:
    """Sum of the last ``window`` rows; null unless the frame is full and free of nulls.

    Rows are cut into runs of ``window``, so every frame is the end of one run and the start of the next: the running
    sum of the present run plus the total of the one before less its running sum ``window`` rows ago. That is one
    addition per row instead of ``window``, and rounding errors do not outlive a run.
    """
    return _rolled(df, key, order, value, window, out).drop("__run")


def rolling_mean(df: DataFrame, key, order: str, value: str, window: int, out: str) -> DataFrame:
    """Mean of the last ``window`` rows; null unless the frame is full."""
    return rolling_sum(df, key, order, value, window, out).withColumn(out, F.col(out) / window)


def decayed_sums(df: DataFrame, key, order: str, terms: dict[str, tuple[Column, float]], block_rows: int | None = None) -> DataFrame:
    """For each (value, rate) of ``terms`` the sum over the series so far of value * rate^age; age counts rows, nulls add 0.

    A scan in two levels. Rows are cut into blocks small enough for weights that grow with the place in the block, so
    within a block these are plain running sums. Blocks are combined by doubling: a row holds the decayed sum over the
    2^k blocks before its own and adds what the row 2^k blocks earlier holds, decayed by that distance, until the decay
    is 0 in a double. All windows follow the order of the series, so they share its exchange, and no row carries a list.
    """
    fastest = max(-math.log(rate) for _, rate in terms.values())
    block = block_rows or max(2, int(_LOG_RANGE / fastest))
    w, keys = _window(key, order), [key] if isinstance(key, str) else list(key)
    df = df.withColumn("__row", F.row_number().over(w) - 1)
    df = df.withColumns({"__block": F.floor(F.col("__row") / block), "__pos": (F.col("__row") % block).cast("double")})
    local = _so_far(Window.partitionBy(*keys, "__block").orderBy(order))
    by_block = Window.partitionBy(*keys).orderBy("__block", order)  # the order of the series, and the one rows are in by then
    df = df.withColumns({
        name: F.coalesce(F.sum(value * F.pow(F.lit(rate), -F.col("__pos"))).over(local), F.lit(0.0))
        * F.pow(F.lit(rate), F.col("__pos")) for name, (value, rate) in terms.items()})
    closed = F.last(F.when(F.col("__pos") == block - 1, F.struct(*terms)), ignorenulls=True).over(
        by_block.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("__before", closed)
    step = 1
    while max(rate for _, rate in terms.values()) ** (block * step) > 0.0:
        df = df.withColumn("__earlier", F.lag("__before", block * step).over(by_block))
        df = df.withColumn("__before", F.when(F.col("__earlier").isNull(), F.col("__before")).otherwise(F.struct(*[
            (F.col("__before")[name] + F.col("__earlier")[name] * rate ** (block * step)).alias(name)
            for name, (_, rate) in terms.items()])))
        step *= 2
    return df.withColumns({
        name: F.col(name) + F.coalesce(F.col("__before")[name], F.lit(0.0)) * F.pow(F.lit(rate), F.col("__pos") + 1)
        for name, (_, rate) in terms.items()}).drop("__row", "__block", "__pos", "__before", "__earlier")


def ewm_std(
    df: DataFrame, key, order: str, value: str, span: int, min_periods: int, out: str, block_rows: int | None = None,
) -> DataFrame:
    """Exponentially weighted, bias-corrected standard deviation with weights (1 - 2/(span+1))^age.

    Age counts rows, so a null ages the values before it. Null where the value is null, before ``min_periods``
    values, and on the first value.
    """
    keep = 1.0 - 2.0 / (span + 1.0)
    w = _window(key, order)
    # deviations from the first value: a constant series then has exactly zero variance
    df = df.withColumns({
        "__n": F.count(value).over(_so_far(w)),
        "__dev": F.col(value) - F.first(value, ignorenulls=True).over(_so_far(w)),
    })
    x = F.col("__dev")
    one = F.when(x.isNotNull(), F.lit(1.0))
    sums = {"__w": (one, keep), "__ww": (one, keep * keep), "__x": (x, keep), "__xx": (x * x, keep)}
    df = decayed_sums(df, key, order, sums, block_rows)
    ready = F.col(value).isNotNull() & (F.col("__n") >= max(min_periods, 2))
    spread = _decayed_covariance("__x", "__x", "__xx")
    return df.withColumn(out, F.when(ready, F.sqrt(F.greatest(spread, F.lit(0.0))))).drop("__n", "__dev", *sums)


def _decayed_covariance(x: str, y: str, xy: str) -> Column:
    """Covariance without bias from decayed sums of x, y, xy, and of weights ``__w`` and squared weights ``__ww``."""
    spread = ratio(xy, "__w") - ratio(x, "__w") * ratio(y, "__w")
    return ratio(spread, 1.0 - ratio("__ww", F.col("__w") * F.col("__w")))


def ewm_cov(
    df: DataFrame, key, order: str, x: str, y: str, span: int, min_periods: int, out: str, block_rows: int | None = None,
) -> DataFrame:
    """Exponentially weighted, bias-corrected covariance of two columns of a series; rows with a null in either count as
    null. With ``x`` as ``y`` it is the square of ``ewm_std``."""
    keep = 1.0 - 2.0 / (span + 1.0)
    w = _window(key, order)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    df = df.withColumn("__both", F.when(both, F.struct(F.col(x).alias("x"), F.col(y).alias("y"))))
    df = df.withColumns({
        "__n": F.count("__both").over(_so_far(w)), "__0": F.first("__both", ignorenulls=True).over(_so_far(w))})
    df = df.withColumns({"__dx": F.col("__both.x") - F.col("__0.x"), "__dy": F.col("__both.y") - F.col("__0.y")})
    dx, dy = F.col("__dx"), F.col("__dy")
    one = F.when(dx.isNotNull(), F.lit(1.0))
    sums = {"__w": (one, keep), "__ww": (one, keep * keep), "__x": (dx, keep), "__y": (dy, keep), "__xy": (dx * dy, keep)}
    df = decayed_sums(df, key, order, sums, block_rows)
    ready = both & (F.col("__n") >= max(min_periods, 2))
    return df.withColumn(out, F.when(ready, _decayed_covariance("__x", "__y", "__xy"))).drop(
        "__both", "__n", "__0", "__dx", "__dy", *sums)


def series_gaps(df: DataFrame, key, order: str, value: str, window: int = 230) -> DataFrame:
    """Per series: rows, null values, and the rows that lose a full window of ``window`` rows to a null (n_rows, n_null, n_lost).

    A null costs the rows after it up to ``window``; overlapping gaps cost a row once. Rows before the first full window
    count as lost only from the row on that would complete it.
    """
    w = _window(key, order)
    keys = [key] if isinstance(key, str) else list(key)
    rows = df.withColumns({"__row": F.row_number().over(w), "__null": F.count_if(F.col(value).isNull()).over(_so_far(w))})
    recent = F.col("__null") - F.coalesce(F.lag("__null", window).over(w), F.lit(0))
    rows = rows.withColumn("__lost", (F.col("__row") >= window) & (recent > 0))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(value).isNull()).alias("n_null"), F.count_if("__lost").alias("n_lost"))


def vol_scaled_momentum(
    df: DataFrame, key, order: str, value: str, span: int = 22, min_periods: int = 22, window: int = 230,
    skip: int = 22, out: str = "momentum",
) -> DataFrame:
    """Sum over ``window`` rows of value / its exponentially weighted deviation, read ``skip`` rows later.

    Adds ``vol``, ``scaled_ret`` and ``out``.
    """
    df = ewm_std(df, key, order, value, span, min_periods, "vol")
    df = df.withColumn("scaled_ret", ratio(value, "vol"))
    df = _rolled(df, key, order, "scaled_ret", window, out)
    keys = [key] if isinstance(key, str) else list(key)
    earlier = F.lag(out, skip).over(Window.partitionBy(*keys).orderBy("__run", order))
    return df.withColumn(out, earlier).drop("__run")
