"""Repeated byte strings, found by sorting suffixes: external induced sorting of shards, joined by content.

Every string of ``length`` bytes picks the smallest hash among its short substrings, its anchor, so equal strings pick
equal anchors. The strings that pick one anchor lie side by side and make a segment; only segments whose anchor occurs
again can hold repeats. Equal segments are combined by hash; what differs goes, anchor by anchor, to the shards. A shard
is what a task gets, of any size; its suffixes are sorted with their common prefixes by external induced sorting.
"""

from __future__ import annotations

import math
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.staging import staged
from .suffix_sort import MEMORY, room, suffix_order
from .text import map_batches, mixed, text_of

LENGTH, ANCHOR, PART = 200, 32, 1 << 22
SHARE = 4 << 20
"""Bytes that a task sorts on average; a byte takes some 35 bytes of memory until the bound of the sorter. A share may be of any size."""
SHARD_SEGMENTS = 6_000
"""Segments of one anchor, about 300 bytes each, that go to one task together; more are cut by where the string stands."""
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, at least ``n`` of each."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(12, n.bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            run = np.full(size, base, dtype=np.uint64)
            run[0] = 1
            _powers[name] = np.multiply.accumulate(run)
    return _powers["up"], _powers["down"]


def _sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any substring follows, see ``_hash``."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * _power(len(data))[1][:len(data)], out=out[1:])
    return out


def _hash(sums: np.ndarray, start: np.ndarray, size) -> np.ndarray:
    """Hash of the bytes from ``start`` on, the same wherever they stand."""
    return mixed((sums[start + size] - sums[start]) * _power(len(sums))[0][start] + np.asarray(size, dtype=np.uint64))


def segments(data: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor hash, content hash, times) of the segments: ``windows`` strings of ``length`` bytes from ``start`` on.

    Periodic text makes the same segment again and again; neighbours that are equal are one entry, ``times`` in a row.
    """
    parts = []
    for offset in range(0, max(len(data) - length + 1, 0), PART):
        text = np.frombuffer(data[offset:offset + PART + length - 1], dtype=np.uint8)
        sums, width = _sums(text), length - anchor + 1
        n = len(text) - anchor + 1
        grams = _hash(sums, np.arange(n), anchor)
        # Leftmost smallest hash among ``width`` in a row, by minima from both ends of blocks.
        keyed = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        keyed[:n] = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(n, dtype=np.uint64)
        blocks = keyed.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        count = len(text) - length + 1
        place = (np.minimum(back[:count], ahead[width - 1:width - 1 + count]) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        windows = np.diff(first, append=count)
        at = place[first]
        content = mixed(_hash(sums, first, windows + (length - 1)) + (at - first).astype(np.uint64))
        gram = grams[at]
        new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (content[1:] != content[:-1]) | (windows[1:] != windows[:-1])])
        head = np.flatnonzero(new)
        parts.append((first[head] + offset, windows[head], gram[head], content[head], np.diff(head, append=len(first))))
    if not parts:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.uint64),) * 2 + (np.zeros(0, dtype=np.int64),)
    return tuple(np.concatenate(x) for x in zip(*parts))


def repeated_windows(text: np.ndarray, sizes: np.ndarray, windows: np.ndarray, length: int = LENGTH, memory: int = MEMORY) -> np.ndarray:
    """For each place of ``text``, whether the string of ``length`` bytes there begins elsewhere too.

    The text is made of parts of ``sizes`` bytes, each followed by a byte that no text has; only the first ``windows``
    strings of a part count. Suffixes that share ``length`` bytes lie side by side, told by the common prefixes.
    """
    wanted, twice = room(len(text), bool, memory), room(len(text), bool, memory)
    twice[:] = False
    starts = np.cumsum(sizes + 1) - sizes - 1
    wanted[:] = False
    for a, n in zip(starts.tolist(), windows.tolist()):
        wanted[a:a + n] = True
    order, shared = suffix_order(text, length, memory)
    group, held = 0, (np.zeros(0, dtype=np.int64),) * 2
    for a in range(0, len(order), 1 << 16):
        place = order[a:a + (1 << 16)]
        groups = group + np.cumsum(shared[a:a + (1 << 16)] < length)
        group = int(groups[-1])
        counts = wanted[place]
        place, groups = (np.concatenate(c) for c in zip(held, (place[counts], groups[counts])))
        same = np.flatnonzero(groups[1:] == groups[:-1])
        twice[place[same]] = True
        twice[place[same + 1]] = True
        held = place[-1:], groups[-1:]
    return twice


# --- on the cluster ---------------------------------------------------------------------------------------------

_SPOT = "id bigint, mark int, start bigint, windows int"
_COUNTED = f"{_SPOT}, gram bigint, content bigint, times bigint"


def _segments_of(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """One row per segment of each text (id, mark, data)."""
    def body(batch):
        out = [[] for _ in range(7)]
        for i, m, data in zip(*(batch.column(c).to_pylist() for c in ("id", "mark", "data"))):
            start, windows, gram, content, times = segments(data, length, anchor)
            if len(start):
                for column, values in zip(out, (np.full(len(start), i), np.full(len(start), m), start, windows, gram.view(np.int64), content.view(np.int64), times)):
                    column.append(values)
        joined = [np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in out]
        return dict(zip(("id", "mark", "start", "windows", "gram", "content", "times"), joined))

    return map_batches(docs, lambda: body, _COUNTED)


def _cut_bytes(n: Column, windows: Column, length: int, shard: int) -> Column:
    """Bytes, at most, that ``_cut_segments`` makes of the ``n`` segments of an anchor, which hold ``windows`` strings."""
    pieces = F.when(n <= shard, n).when(n <= 16 * shard, F.least(windows, n * F.ceil(n / shard))).otherwise(windows)
    return windows + pieces * length


def _cut_segments(texts: DataFrame, length: int, anchor: int, shard: int) -> DataFrame:
    """Bytes of the listed segments; those of an anchor with very many are cut by where the string stands to the anchor."""
    def body(batch):
        rows = []
        for i, m, data, spots in zip(*(batch.column(c).to_pylist() for c in ("id", "mark", "data", "spots"))):
            for s in spots:
                pieces = min(-(-s["n"] // shard), 16)
                if pieces == 1:
                    rows.append((s["gram"], i, m, s["start"], s["windows"], s["single"], data[s["start"]:s["start"] + s["windows"] + length - 1]))
                    continue
                one = data[s["start"]:s["start"] + s["windows"] + length - 1]
                sums = _sums(np.frombuffer(one, dtype=np.uint8))
                grams = _hash(sums, np.arange(len(one) - anchor + 1), anchor)
                at = int(np.flatnonzero(grams.view(np.int64) == s["gram"])[0])
                deal = -(-s["n"] // (16 * shard))
                piece = (at - np.arange(s["windows"])) * pieces // (length - anchor + 1)
                whole = _hash(sums, np.arange(s["windows"]), length) if deal > 1 else None
                runs = np.flatnonzero(np.diff(piece, prepend=-1)) if deal == 1 else np.arange(s["windows"])
                for a, b in zip(runs, [*runs[1:], s["windows"]]):
                    key = np.array([s["gram"]], dtype=np.int64).view(np.uint64) + np.uint64(piece[a] + 1)
                    if deal > 1:  # single strings, dealt out by their own hash
                        key = mixed(key) + whole[a] % np.uint64(deal)
                    rows.append((int(mixed(key).view(np.int64)[0]), i, m, s["start"] + int(a), int(b - a), s["single"], one[a:b + length - 1]))
        columns = list(zip(*rows)) if rows else [[]] * 7
        return dict(zip(("shard", "id", "mark", "start", "windows", "single", "data"), columns))

    return map_batches(texts, lambda: body, f"shard bigint, {_SPOT}, single boolean, data binary")


def _joint_text(batches, memory: int) -> tuple[np.ndarray, list[pa.RecordBatch]]:
    """The segments of a shard in one text, each followed by a byte that no text has, written batch by batch; and their other columns."""
    with tempfile.TemporaryFile() as file:
        rows = []
        for batch in batches:
            for data in batch.column("data"):
                file.write(data.as_buffer())
                file.write(b"\xff")
            size = pa.compute.binary_length(batch.column("data"))
            rows.append(batch.drop_columns(["data", "shard"]).append_column("size", size))
        n = file.tell()
        file.flush()
        return np.memmap(file, dtype=np.uint8, mode="r", shape=(n,)) if n else np.zeros(0, dtype=np.uint8), rows


def _sort_shards(parts: DataFrame, length: int, memory: int, tasks: int) -> DataFrame:
    """Repeated ranges (id, mark, start, end) in the single segments. What a task gets is one shard, of any size.

    The number of tasks is given, as adaptive execution would merge them by the number of cores.
    """
    def run(batches):
        text, rows = _joint_text(batches, memory)
        if not len(text):
            return
        sizes, windows = (np.concatenate([b.column(c).to_numpy() for b in rows]).astype(np.int64) for c in ("size", "windows"))
        twice, at = repeated_windows(text, sizes, windows, length, memory), 0
        for batch in rows:
            out = []
            for i, m, start, n, single, size in zip(*(batch.column(c).to_pylist() for c in ("id", "mark", "start", "windows", "single", "size"))):
                found = twice[at:at + n]
                at += size + 1
                if single and found.any():
                    edge = np.flatnonzero(np.diff(found, prepend=False, append=False))
                    out += [(i, m, start + a, start + b - 1 + length) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["id", "mark", "start", "end"])

    return parts.repartition(tasks, "shard").mapInArrow(run, "id bigint, mark int, start bigint, end bigint")


def _removed(batch: pa.RecordBatch) -> dict:
    out: dict[str, list] = {"id": batch.column("id"), "mark": batch.column("mark"), "n_removed": [], "n_spans": [], "kept": []}
    for data, spans in zip(batch.column("data").to_pylist(), batch.column("spans").to_pylist()):
        runs = []
        for s in sorted((s["start"], s["end"]) for s in spans):
            if runs and s[0] <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], s[1])
            else:
                runs.append(list(s))
        edges = [0, *(x for r in runs for x in r), len(data)]
        out["kept"].append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
        out["n_removed"].append(sum(b - a for a, b in runs))
        out["n_spans"].append(len(runs))
    return out


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR,
    shard: int = SHARD_SEGMENTS, memory: int = MEMORY, share: int = SHARE,
) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept.

    Texts are their UTF-8 bytes. Each byte inside a string of ``length`` bytes that also begins anywhere else, in the same
    row or another, is removed; overlaps count, and strings are judged on the input. ``kept`` holds the bytes that stay
    where something was removed, and is null where the text stays whole. Null texts are empty; texts shorter than
    ``length`` stay. Rows are documents of their own: rows that repeat an id and a text lose all of it, if it is long
    enough. Rows without id are told apart by their text alone. A task sorts ``share`` bytes on average, so its memory
    doesn't grow with the input.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("given"), F.encode(text_of(text_col), "UTF-8").alias("data"))
    rows = rows.withColumn("id", F.coalesce("given", F.xxhash64("data"))).withColumn(
        "mark", F.pmod(F.xxhash64(F.lit("mark"), "data"), F.lit((1 << 31) - 1)).cast("int"))
    long_enough = rows.where(F.octet_length("data") >= length).select("id", "mark", "data")
    all_spots = staged(_segments_of(long_enough, length, anchor), "segments")
    twice = all_spots.groupBy("gram").agg(F.sum("times").alias("n")).where("n > 1").select("gram")
    spots = staged(all_spots.join(twice, "gram", "left_semi"), "spots")
    place = F.struct("id", "mark", "start", "windows")
    distinct = staged(spots.groupBy("gram", "content").agg(F.sum("times").alias("copies"), F.min(place).alias("at")), "distinct")

    open_grams = staged(distinct.groupBy("gram").agg(
        F.count(F.lit(1)).alias("n"), F.min("copies").alias("least"), F.sum("at.windows").alias("windows")).where("n > 1 and least = 1").drop("least"), "open")
    n_bytes = open_grams.agg(F.sum(_cut_bytes(F.col("n"), F.col("windows"), length, shard))).first()[0] or 0
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(n_bytes / share))
    looked_at = distinct.join(open_grams.select("gram", "n"), "gram").select(
        "at.*", "gram", F.col("n").cast("int").alias("n"), (F.col("copies") == 1).alias("single"))
    listed = looked_at.groupBy("id", "mark").agg(
        F.collect_list(F.struct("start", "windows", "gram", "n", "single")).alias("spots"))  # of one text
    concerned = spots.select("id", "mark").distinct()
    texts = staged(long_enough.join(concerned.hint("shuffle_hash"), ["id", "mark"], "left_semi").dropDuplicates(["id", "mark"]), "texts")
    parts = _cut_segments(texts.join(listed, ["id", "mark"]), length, anchor, shard)
    sorted_out = _sort_shards(parts, length, memory, tasks)

    copied = spots.join(distinct.where("copies > 1").select("gram", "content"), ["gram", "content"]).select(
        "id", "mark", "start", (F.col("start") + F.col("windows") * F.col("times") + (length - 1)).alias("end"))
    spans = copied.unionByName(sorted_out).groupBy("id", "mark").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    changed = map_batches(texts.join(spans, ["id", "mark"]), lambda: _removed, "id bigint, mark int, n_removed bigint, n_spans bigint, kept binary")
    changed = staged(changed.withColumn("kept_sha256", F.sha2("kept", 256)), "changed")
    whole = rows.select("given", "id", "mark", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("sha"))
    return whole.join(changed, ["id", "mark"], "left").select(
        F.col("given").alias(id_col), "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept")
