"""Measured sizes and the choices that depend on them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_BYTES = 64 << 20
"""Largest table sent whole to every executor."""

GROUP_ROWS = 2_000_000
"""Largest group ranked inside one task; larger ones are split by value."""

SERIES_ROWS = 250_000
"""Rows of whole series that a task sorts for its windows. The windows of a signal hold some 500 bytes a row."""


def span_days(df: DataFrame, date: str = "dt") -> int:
    """Calendar days from the first to the last date: an upper bound of the number of distinct dates, and of the
    rows of one series under the one-row-per-asset-and-date contract. Reads one column, without a shuffle."""
    first, last = df.agg(F.min(date), F.max(date)).first()
    return 0 if first is None else (last - first).days + 1


def panel_size(df: DataFrame, date: str = "dt") -> tuple[int, int]:
    """``span_days`` and the number of rows, in one aggregation."""
    first, last, rows = df.agg(F.min(date), F.max(date), F.count(F.lit(1))).first()
    return 0 if first is None else (last - first).days + 1, rows


def series_parts(spark: SparkSession, max_rows: int) -> int:
    """Tasks, or buckets, for the series of a panel of up to ``max_rows`` rows: SERIES_ROWS each, at least one a core."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(max_rows / SERIES_ROWS))


def by_series(df: DataFrame, max_rows: int | None, key: str = "asset") -> DataFrame:
    """Deal whole series to ``series_parts`` tasks, by the exchange that windows over the series need anyway.

    Left to the windows, their number would be ``spark.sql.shuffle.partitions`` or what adaptive execution merges them
    to, and a task would grow with the panel. Without ``max_rows`` (None or 0) the panel stays as it is dealt.
    """
    return df.repartition(series_parts(df.sparkSession, max_rows), key) if max_rows else df


def largest_group(df: DataFrame, by: list[str]) -> int:
    """Rows of the largest group; counts are combined before the shuffle."""
    if not by:
        return df.count()
    return df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def join_small(big: DataFrame, small: DataFrame, on, max_rows: int | None, how: str = "left") -> DataFrame:
    """Join ``small`` to ``big``, broadcasting it only if its proven row bound keeps it below BROADCAST_BYTES.

    Without a bound, or above it, the join is left to the optimizer: a shuffle join that adaptive execution splits
    when one key is hot.
    """
    if max_rows is not None and max_rows * (32 + 16 * len(small.columns)) <= BROADCAST_BYTES:
        small = F.broadcast(small)
    return big.join(small, on, how)
