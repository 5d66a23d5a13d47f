"""Hard negatives: candidates in Hilbert-ordered blocks, read only where interval arithmetic over their zone maps asks for it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..sources.staging import staged
from .hilbert import hilbert_keys
from .text import small_batches
from .vectors import integers, matrix, usual_length

SCALE, BITS, BLOCK, ANCHORS, PART = 256, 3, 256, 2048, 16
"""Entries become floor(256 c); bits a dimension of the curve; candidates a block; anchors and blocks that meet at once."""
_LOW, _HIGH = 1 - (1 << 63), (1 << 63) - 1
"""Below and above any score; both can be negated."""


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exact: in doubles where no sum can reach 2^53, else in longs."""
    reach = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if reach < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def score_bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest product that each row of ``a`` can have with any vector between ``low`` and ``high``."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


def _packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, dtype="<i4").tobytes()


def _unpacked(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<i4").reshape(-1, size)


_BLOCKS = ("block bigint, n int, label_low int, label_high int, low binary, high binary, ids array<bigint>, labels array<int>, "
           "x binary, ordinal bigint, anchors array<struct<slot:int,floor:bigint>>")


def blocks_of(rows: DataFrame, size: int, reach: tuple[int, int], every: int, positives: int, block_rows: int = BLOCK) -> DataFrame:
    """Rows (vec_id, label, x) as blocks of ``block_rows`` rows in the order of label and Hilbert key, written as Parquet.

    A block carries its zone map: the range of labels and the least and largest entry of each dimension. Its anchors
    carry the score of their last positive within the block, a floor under that of all rows.
    """
    low, step = reach[0], max((reach[1] - reach[0]) >> BITS, 0) + 1

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch, size)
                keys = hilbert_keys((x - low) // step, BITS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("label"), pa.array(keys, pa.binary()),
                     pa.array([_packed(r) for r in x], pa.binary())], ["vec_id", "label", "key", "x"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, ordinal = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int, int, bytes]] = []

        def block(part: list[tuple[int, int, bytes]]) -> list:
            nonlocal made, ordinal
            ids, labels = np.array([r[0] for r in part]), np.array([r[1] for r in part])
            x = _unpacked(b"".join(r[2] for r in part), size)
            slots = np.flatnonzero(ids % every == 0)
            floors = []
            if len(slots):
                scores = products(x[slots], x)
                for s, slot in zip(scores, slots):
                    own = np.sort(s[(labels == labels[slot]) & (ids != ids[slot])])
                    floors.append({"slot": int(slot), "floor": int(own[-positives]) if len(own) >= positives else _LOW})
            out = [task << 32 | made, len(part), int(labels.min()), int(labels.max()), _packed(x.min(axis=0)),
                   _packed(x.max(axis=0)), ids.tolist(), labels.tolist(), x.tobytes(), ordinal, floors]
            made += 1
            ordinal += len(slots)
            return out

        def batch_of(parts: list[list]) -> pa.RecordBatch:
            schema = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("label_low", pa.int32()), ("label_high", pa.int32()),
                                ("low", pa.binary()), ("high", pa.binary()), ("ids", pa.list_(pa.int64())),
                                ("labels", pa.list_(pa.int32())), ("x", pa.binary()), ("ordinal", pa.int64()),
                                ("anchors", pa.list_(pa.struct([("slot", pa.int32()), ("floor", pa.int64())])))])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*parts), schema)], schema=schema)

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "x")))
            full = len(held) // block_rows * block_rows
            if full:
                yield batch_of([block(held[i:i + block_rows]) for i in range(0, full, block_rows)])
                held = held[full:]
        if held:
            yield batch_of([block(held)])

    placed = rows.mapInArrow(keyed, "vec_id bigint, label int, key binary, x binary")
    order = ("label", "key", "vec_id", "x")
    return staged(placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("key").mapInArrow(cut, _BLOCKS), "blocks")


def anchor_chunks(blocks: DataFrame, size: int, chunk_rows: int = ANCHORS) -> DataFrame:
    """(chunk, anchors): runs of ``chunk_rows`` anchors in the blocks' order. An anchor: pos, id, label, x, windows (id, low, high).

    Its one window asks for scores from its floor on. Blocks know how many anchors their task met before; with the
    number of anchors of each task (a row per task) that gives their places without sorting.
    """
    task = F.shiftright("block", 32)
    before = blocks.groupBy(task.alias("task")).agg(F.sum(F.size("anchors")).alias("n")).select(
        "task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))  # as many rows as tasks wrote blocks
    found = blocks.where(F.size("anchors") > 0).withColumn("task", task).join(F.broadcast(before), "task")
    place = F.col("before") + F.col("ordinal") + F.col("nth")
    rows = found.select("before", "ordinal", "ids", "labels", "x", F.posexplode("anchors").alias("nth", "a"))
    window = F.struct(F.lit(None).cast("bigint").alias("id"), F.col("a.floor").alias("low"), F.lit(_HIGH).alias("high"))
    rows = rows.select(
        F.floor(place / chunk_rows).alias("chunk"), F.struct(
            (place % chunk_rows).cast("int").alias("pos"), F.get("ids", F.col("a.slot")).alias("id"),
            F.get("labels", F.col("a.slot")).alias("label"),
            F.substring("x", F.col("a.slot") * (4 * size) + 1, F.lit(4 * size)).alias("x"), F.array(window).alias("windows")).alias("a"))
    return staged(rows.groupBy("chunk").agg(F.collect_list("a").alias("anchors")), "anchors")  # chunk_rows at most


class _Anchors:
    """A chunk of anchors as arrays; windows padded with empty ones."""

    def __init__(self, rows: list[dict], size: int):
        rows = sorted(rows, key=lambda r: r["pos"])
        self.pos = np.array([r["pos"] for r in rows])
        self.ids = np.array([r["id"] for r in rows])
        self.labels = np.array([r["label"] for r in rows])
        self.x = _unpacked(b"".join(r["x"] for r in rows), size)
        most = max((len(r["windows"]) for r in rows), default=0)
        self.low = np.full((len(rows), most), _HIGH, dtype=np.int64)
        self.high = np.full((len(rows), most), _LOW, dtype=np.int64)
        for i, r in enumerate(rows):
            for k, w in enumerate(r["windows"]):
                self.low[i, k], self.high[i, k] = w["low"], w["high"]


def _cells(chunks: DataFrame, blocks: DataFrame, parts: int) -> DataFrame:
    """Chunks and blocks of one cell (chunk, part) next to each other in a task, the chunk first.

    ``blocks`` has the columns chunk, block and others; the chunk goes to every part of the blocks.
    """
    left = chunks.select("chunk", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "anchors")
    right = blocks.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int"))
    both = left.unionByName(right, allowMissingColumns=True)
    return both.repartition("chunk", "part").sortWithinPartitions("chunk", "part", F.asc_nulls_first("block"))


def _streamed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[tuple[int, int], _Anchors, dict]]:
    """(cell, its anchors, a row of a block) in turn; a task holds one chunk and one batch."""
    anchors = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["block"] is None:
                anchors = _Anchors(row["anchors"], size)
            else:
                yield (row["chunk"], row["part"]), anchors, row


def needed_blocks(chunks: DataFrame, blocks: DataFrame, size: int, parts: int, same: bool) -> DataFrame:
    """(chunk, block, who): the anchors (as places in the chunk) with a window that the block's bounds reach.

    Only the zone maps are read. Blocks without a row of the anchor's label (``same``) or of another one are passed over.
    """
    n = chunks.count()  # numbered from 0
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")) if n else F.array().cast("array<bigint>")
    zones = blocks.select(F.explode(every).alias("chunk"), "block", "label_low", "label_high", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, bytes]] = []
        for (chunk, _), a, z in _streamed(batches, size):
            least, most = score_bounds(a.x, _unpacked(z["low"], size), _unpacked(z["high"], size))
            reached = ((a.low <= most) & (a.high >= least) & (a.low <= a.high)).any(axis=1)
            if same:
                reached &= (a.labels >= z["label_low"]) & (a.labels <= z["label_high"])
            else:
                reached &= (a.labels != z["label_low"]) | (a.labels != z["label_high"])
            if reached.any():
                out.append((chunk, z["block"], np.flatnonzero(reached).astype("<i4").tobytes()))
            if len(out) >= 256:
                yield _needed(out)
                out = []
        if out:
            yield _needed(out)

    return staged(_cells(chunks, zones, parts).mapInArrow(run, "chunk bigint, block bigint, who binary"), "needed")


def _needed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    chunk, block, who = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(block, pa.int64()), pa.array(who, pa.binary())], ["chunk", "block", "who"])


_FOUND = "chunk bigint, pos int, window int, id bigint, score bigint"


def search(chunks: DataFrame, blocks: DataFrame, size: int, parts: int, same: bool, k: int) -> DataFrame:
    """(chunk, pos, window, id, score, rank): for each window of each anchor its ``k`` best rows, of the same label or of others.

    Higher scores first, then smaller ids. Every needed block is read whole and compared with the anchors that need it;
    each cell keeps ``k`` rows a window, and the best of all cells are taken by a window with a limit in each task.
    """
    needed = needed_blocks(chunks, blocks, size, parts, same)
    read = needed.join(blocks.select("block", "ids", "labels", "x"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, a, best = None, None, {}

        def told() -> pa.RecordBatch:
            rows = [(cell[0], int(a.pos[i]), w, r, s) for (i, w), found in best.items() for s, r in found]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))],
                ["chunk", "pos", "window", "id", "score"])

        for now, anchors, block in _streamed(batches, size):
            if now != cell:
                if best:
                    yield told()
                cell, best = now, {}
            a = anchors
            who = np.frombuffer(block["who"], dtype="<i4")
            ids, labels = np.array(block["ids"]), np.array(block["labels"])
            order = np.argsort(ids, kind="stable")  # so that equal scores come by id
            ids, labels, x = ids[order], labels[order], _unpacked(block["x"], size)[order]
            scores = products(a.x[who], x)
            fits = (labels[None, :] == a.labels[who][:, None]) if same else (labels[None, :] != a.labels[who][:, None])
            fits &= ids[None, :] != a.ids[who][:, None]
            for w in range(a.low.shape[1]):
                inside = np.where(fits & (scores >= a.low[who, w][:, None]) & (scores <= a.high[who, w][:, None]), scores, _LOW)
                hits = np.flatnonzero(inside.max(axis=1, initial=_LOW) > _LOW)
                top = np.argsort(-inside[hits], axis=1, kind="stable")[:, :k]
                for i, columns in zip(hits, top):
                    found = best.setdefault((int(who[i]), w), [])
                    found += [(int(inside[i, c]), int(ids[c])) for c in columns if inside[i, c] > _LOW]
                    found.sort(key=lambda f: (-f[0], f[1]))
                    del found[k:]
        if best:
            yield told()

    rows = _cells(chunks, read, parts).mapInArrow(run, _FOUND)
    order = Window.partitionBy("chunk", "pos", "window").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    every: int = 50, relabel: int = 7, positives: int = 5, negatives: int = 3, block_rows: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors, ids divisible by ``every``.

    Entries become floor(256 c), scores are integer inner products; ids divisible by ``relabel`` first get the label
    (label + 1) % 10. An anchor's positives are its ``positives`` best other rows of its label. For each, the best
    ``negatives`` rows of other labels whose score is 50 to 95 % of the positive's are returned; a positive without
    such rows, and so any with a negative score, has none.

    A null id, label or vector, a null or non-finite entry, a vector whose length isn't the most frequent one, and an
    entry so large that a score might not fit a long: such rows take no part. Rows that repeat an id are candidates
    and anchors of their own, but never partners of an anchor with their id. Ties go to the smaller id. No rows: no rows.

    All rows move once into blocks. Bounds are taken from zone maps for every anchor and block, an anchor's floor from
    its own block; what they admit is read and compared in cells of at most ``ANCHORS`` anchors and some ``PART``
    blocks, so neither a label nor a vector with very many rows fills a task.
    """
    spark: SparkSession = vectors.sparkSession
    small_batches(spark)
    size = usual_length(vectors, vector_col)
    most = math.isqrt(_HIGH // max(size, 1))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("__v"), F.col(label_col).cast("int").alias("label"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    rows = rows.withColumn("label", F.when(F.col("vec_id") % relabel == 0, ((F.col("label").cast("bigint") + 1) % 10).cast("int")).otherwise(F.col("label")))
    rows = integers(rows, "__v", size, SCALE, min(most, (1 << 31) - 1) - 1).select("vec_id", "label", "x")
    reach = rows.agg(F.min(F.array_min("x")).alias("a"), F.max(F.array_max("x")).alias("b")).first()
    names = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if reach["a"] is None:
        return spark.createDataFrame([], names)
    blocks = blocks_of(rows, size, (reach["a"], reach["b"]), every, positives, block_rows)
    parts = max(1, -(-blocks.count() // PART))
    chunks = anchor_chunks(blocks, size)
    near = staged(search(chunks, blocks, size, parts, True, positives), "positives")

    windows = near.select("chunk", "pos", F.struct(
        "rank", F.col("id").alias("id"), F.expr("score div 2 + score % 2").alias("low"),
        F.expr("score div 20 * 19 + (score % 20) * 19 div 20").alias("high"), "score").alias("w")).where("w.score >= 0")
    windows = windows.groupBy("chunk", "pos").agg(F.sort_array(F.collect_list("w")).alias("windows"))  # one per positive
    alone = chunks.select("chunk", F.explode("anchors").alias("a")).select("chunk", "a.pos", "a.id", "a.label", "a.x")
    alone = alone.join(windows, ["chunk", "pos"]).select("chunk", F.struct("pos", "id", "label", "x", "windows").alias("a"))
    asked = staged(alone.groupBy("chunk").agg(F.collect_list("a").alias("anchors")), "asked")
    far = search(asked, blocks, size, parts, False, negatives)
    pairs = asked.select("chunk", F.explode("anchors").alias("a")).select(
        "chunk", "a.pos", F.col("a.id").alias("anchor_id"), F.posexplode("a.windows").alias("window", "w"))
    return far.join(pairs, ["chunk", "pos", "window"]).select(
        "anchor_id", F.col("w.id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        F.col("w.score").alias("positive_score"), F.col("score").alias("negative_score"))
