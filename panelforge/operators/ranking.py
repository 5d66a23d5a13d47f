"""Exact ranks and percentiles within groups of any size.

Groups that fit one task are ranked by a window. Larger groups are dealt to tasks by ranges of their values, and each
value's rank is its place in its range plus the rows in the ranges below.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.sizing import GROUP_ROWS, join_small, largest_group
from ..sources.staging import staged


def rank_counts(
    df: DataFrame, by: list[str], value: str, prefix: str, group_rows: int = GROUP_ROWS, largest: int | None = None,
) -> DataFrame:
    """Add, for each row's value within its group, the rows ``<prefix>_below``, tied (``_ties``) and in all (``_n``).

    ``value`` must not be null. ``largest`` is the size of the largest group, or a bound of it, if already known.
    ``df`` must be a table or staged if a group may exceed ``group_rows``: it is then read more than once.
    """
    below, ties, total = f"{prefix}_below", f"{prefix}_ties", f"{prefix}_n"
    if largest is None:
        largest = largest_group(df, by)
    if largest <= group_rows:
        return _window_counts(df, by, value, below, ties, total)
    hot = staged(df.groupBy(*by).count().where(F.col("count") > group_rows).select(*by))
    n_hot = hot.count()
    cool = _window_counts(join_small(df, hot, by, n_hot, "left_anti"), by, value, below, ties, total)
    large = join_small(df, hot, by, n_hot, "left_semi")
    ranks = value_ranks(large, by, value, prefix)
    return cool.unionByName(large.join(ranks, [*by, value], "left"))


def _window_counts(df: DataFrame, by: list[str], value: str, below: str, ties: str, total: str) -> DataFrame:
    return df.withColumns({
        below: (F.rank().over(Window.partitionBy(*by).orderBy(value)) - 1).cast("long"),
        ties: F.count(F.lit(1)).over(Window.partitionBy(*by, value)),
        total: F.count(F.lit(1)).over(Window.partitionBy(*by)),
    })


def value_ranks(df: DataFrame, by: list[str], value: str, prefix: str) -> DataFrame:
    """One row per group and distinct value with its ``_below``, ``_ties`` and ``_n`` counts.

    Ties collapse before the shuffle. NaN ranks above infinity, as in a window.
    """
    return ranked_values(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias(f"{prefix}_ties")), by, value, prefix)


def ranked_values(values: DataFrame, by: list[str], value: str, prefix: str) -> DataFrame:
    """``value_ranks`` from distinct values per group with their counts (``_ties``), in two scans whatever a group's size.

    Values are dealt by ranges of (group, value), so a group is spread evenly over as many tasks as it needs and every
    task counts on through its sorted rows. The counts of a group's tasks, a row each, give what lies below a task.
    """
    below, ties, total = f"{prefix}_below", f"{prefix}_ties", f"{prefix}_n"
    placed = staged(_counted_ranges(values, by, value, ties))
    parts = placed.groupBy(*by, "__part").agg(F.sum(ties).alias("__rows"))
    order = Window.partitionBy(*by).orderBy("__part")  # a row per task that holds some of the group
    offsets = staged(parts.select(
        *by, "__part",
        F.coalesce(F.sum("__rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__rows").over(Window.partitionBy(*by)).alias(total),
    ))
    placed = join_small(placed, offsets, [*by, "__part"], offsets.count())
    return placed.select(*by, value, (F.col("__before") + F.col("__in")).alias(below), ties, total)


def _counted_ranges(values: DataFrame, by: list[str], value: str, ties: str) -> DataFrame:
    """Sorted ranges of (group, value) with the task of each row (``__part``) and the rows of its group before it there (``__in``)."""
    rows = values.select(*by, value, ties)
    kinds = [(f.name, f.dataType.simpleString()) for f in rows.schema]
    n = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, group, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.ones(batch.num_rows, dtype=bool)
            keys = [batch.column(k) for k in range(n)]
            first, last = [k[0].as_py() for k in keys], [k[-1].as_py() for k in keys]
            new[1:] = np.any([pc.fill_null(pc.not_equal(k[1:], k[:-1]), True).to_numpy(zero_copy_only=False) for k in keys] or [new[1:] & False], axis=0)
            new[0] = first != group
            size = batch.column(ties).to_numpy()
            running = np.cumsum(size) - size
            starts = np.flatnonzero(new)
            inside = running + seen  # of the group that the last batch ended with
            base = np.repeat(running[starts], np.diff(starts, append=len(size)))
            inside[len(size) - len(base):] = running[len(size) - len(base):] - base
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(size), part, dtype=np.int32)), pa.array(inside.astype(np.int64))],
                [*batch.schema.names, "__part", "__in"])
            group, seen = last, int(inside[-1] + size[-1])

    dealt = rows.repartitionByRange(*by, value).sortWithinPartitions(*by, value)
    return dealt.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in [*kinds, ("__part", "int"), ("__in", "bigint")]))


def average_rank(prefix: str):
    """Rank with ties averaged, from the counts of ``rank_counts``."""
    return F.col(f"{prefix}_below") + (F.col(f"{prefix}_ties") + 1) / 2


def quantile_bucket(prefix: str, bins: int):
    """Bucket 1..bins by the share of the group below the value; tied values share a bucket."""
    return F.expr(f"{prefix}_below * {int(bins)} div {prefix}_n") + 1


def exact_percentiles(df: DataFrame, value: str, shares: list[float], names: list[str], accuracy: int = 10_000) -> DataFrame:
    """One row of percentiles with linear interpolation, over any number of rows, in two scans of one column.

    The first scan merges a quantile sketch, which gives two values around each place, some 4 / ``accuracy`` of the rows
    apart. The second counts the rows between these brackets and each value within them; the few values are then ranked
    exactly. No task or driver holds more than a sketch. Nulls, NaN and infinities are left out.
    """
    finite = F.abs(F.col(value)) < F.lit(float("inf"))  # NaN is larger than any number
    rows = df.where(finite).select(F.col(value).cast("double").alias("__v"))
    margin = 2.0 / accuracy
    sides = [x for s in shares for x in (max(s - margin, 0.0), min(s + margin, 1.0))]
    n, cuts = rows.agg(F.count("__v"), F.percentile_approx("__v", F.array(*map(F.lit, sides)), accuracy)).first()
    places = [s * (n - 1) for s in shares] if n else []
    around = [(low if s > margin else -math.inf, high if s < 1 - margin else math.inf)
              for s, low, high in zip(shares, (cuts or [])[::2], (cuts or [])[1::2])]
    brackets = _disjoint(around if n > accuracy else [(-math.inf, math.inf)])  # of few rows all are ranked
    at = _values_at(rows, {f(p) for p in places for f in (math.floor, math.ceil)}, brackets)
    out = [None] * len(names)
    for i, p in enumerate(places):
        a, b = at[math.floor(p)], at[math.ceil(p)]
        out[i] = a + (b - a) * (p - math.floor(p))
    return df.sparkSession.range(1).select(*[F.lit(x).cast("double").alias(name) for name, x in zip(names, out)])


def _disjoint(brackets: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for low, high in sorted(brackets):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _values_at(rows: DataFrame, places: set[int], brackets: list[tuple[float, float]]) -> dict[int, float]:
    """Values at 0-based places of the sorted order, all of them within ``brackets`` (disjoint, rising)."""
    if not places:
        return {}
    v = F.col("__v")
    # 0 below the first bracket, 1 in it, 2 between it and the second, and so on
    region = reduce(add, [(v >= F.lit(low)).cast("int") + (v > F.lit(high)).cast("int") for low, high in brackets])
    counts = rows.select(region.alias("__region"), v).groupBy("__region", F.when(F.col("__region") % 2 == 1, v).alias("__v"))
    counts = staged(counts.agg(F.count(F.lit(1)).alias("r_ties")))
    sizes = {r["__region"]: r["n"] for r in counts.groupBy("__region").agg(F.sum("r_ties").alias("n")).collect()}
    wanted, before = [], 0
    for k in sorted(sizes):
        wanted += [(k, p - before, p) for p in places if before <= p < before + sizes[k] and k % 2]
        before += sizes[k]
    ranked = ranked_values(counts.where(v.isNotNull()), ["__region"], "__v", "r")
    here = [(F.col("__region") == k) & (F.col("r_below") <= p) & (F.col("r_below") + F.col("r_ties") > p) for k, p, _ in wanted]
    found = ranked.where(reduce(or_, here)).collect()  # a row per place at most
    return {place: r["__v"] for k, p, place in wanted for r in found if r["__region"] == k and r["r_below"] <= p < r["r_below"] + r["r_ties"]}
