"""Lines that several documents share stay in one of them (native: DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.staging import staged
from .text import ascii_lower, digest_pair, let, stripped, text_of

HOT_ROWS, HOT_SHARE = 1000, 1000
"""A key is hot with more lines than both the first number and that part of all shared lines."""


def lines_of(c: Column) -> Column:
    """Lines between ``\\n``; an empty text is one empty line."""
    return F.split(c, "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(stripped(line))


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Per row of ``docs``: id, n_lines, n_dropped, text (the lines that stay, joined by ``\\n``), and ``carry``.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. A key of ``min_chars`` code
    points or more that ``min_docs`` or more documents hold loses its lines everywhere but in the document with the
    smallest id, which keeps all of them. Documents are distinct ids: rows that repeat an id count once and lose the
    same lines. A row without id keeps its lines and isn't counted. A null text is one empty line. No rows: no rows.

    One row per line, 16 bytes of hash each, is grouped with map-side combine, so a line of many documents costs one
    row per task. Keys with more than a ``HOT_SHARE``-th of the shared lines, fewer than ``HOT_SHARE`` of them, are
    broadcast; their lines are settled without the join and dealt by document, so no task gets a hot key's lines. The text
    itself moves once.
    """
    if min_docs < 2:
        raise ValueError("min_docs starts at 2")
    base = docs.select(
        F.col(id_col).alias("__id"), text_of(text_col).alias("__text"),
        F.struct(F.lit(0).alias("__0"), *[F.col(c) for c in carry]).alias("__rest"))
    entries = base.where(F.col("__id").isNotNull()).select(
        "__id", F.posexplode(F.transform(lines_of(F.col("__text")), line_key)).alias("pos", "key")
    ).where(F.char_length("key") >= min_chars).select("__id", "pos", *digest_pair(F.col("key")))
    counted = F.min("__id").alias("first"), F.max("__id").alias("last"), F.count(F.lit(1)).alias("rows")
    if min_docs > 2:
        counted += (F.count_distinct("__id").alias("n"),)
    held = entries.groupBy("h1", "h2").agg(*counted).where(F.col("first") != F.col("last"))
    if min_docs > 2:
        held = held.where(F.col("n") >= min_docs)
    held = staged(held.select("h1", "h2", "first", "rows"), "shared-lines")
    bound = max(HOT_ROWS, (held.agg(F.sum("rows")).first()[0] or 0) // HOT_SHARE)
    hot = held.where(F.col("rows") > bound).select("h1", "h2", F.col("first").alias("hot_first"))  # below HOT_SHARE rows
    cold = held.where(F.col("rows") <= bound).select("h1", "h2", "first")
    marked = entries.join(F.broadcast(hot), ["h1", "h2"], "left")
    spread = F.when(F.col("hot_first").isNull(), F.col("h1")).otherwise(F.xxhash64("__id", "pos"))
    marked = marked.select("__id", "pos", spread.alias("h1"), "h2", "hot_first")
    found = marked.join(cold, ["h1", "h2"], "left").where(F.col("__id") > F.coalesce("hot_first", "first"))
    drops = found.groupBy("__id").agg(F.collect_set("pos").alias("__drop"))  # bounded by the lines of one document

    def kept(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drop"))
        text = F.when(F.col("__drop").isNull(), F.col("__text")).otherwise(
            F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n"))
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"), text.alias("text"))

    joined = base.join(drops.hint("shuffle_hash"), "__id", "left")
    return joined.select(
        F.col("__id").alias(id_col), let(lines_of(F.col("__text")), kept).alias("__out"), "__rest",
    ).select(id_col, "__out.n_lines", "__out.n_dropped", "__out.text", *[F.col("__rest")[c].alias(c) for c in carry])
