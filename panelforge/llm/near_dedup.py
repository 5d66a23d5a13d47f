"""Near duplicates: a chosen-path similarity join over minwise tokens, with links confirmed on full shingle sets.

Every distinct shingle set is sketched once. In each of several independent trees a set starts in the node of one of its
minwise tokens; a node that is too large branches by further tokens (one child or two, chosen by the node, so all its sets
go the same ways; as many as a pair's chance to meet needs at the last level), a small one, or one without tokens left, compares its sets exhaustively by 1-bit sketches.
Sets with a candidate are confirmed leaf by leaf on their full sets. A first pass over few trees connects large groups; the
whole pass over all trees then only compares sets that it left unconnected.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..sources.staging import staged
from .components import components
from .text import map_batches, mixed, shingle_hashes, text_of, word_hashes

BITS, TREES, COORDINATES = 256, 12, 20
"""Bits of a sketch; trees; minwise tokens of 16 bits that a set has in each tree (2 a level)."""
LEAF, NODE_ROWS, FIRST_TREES, MISSED = 256, 20_000, 2, 1e-4
"""Largest node that isn't split; largest node that one task splits; trees of the first pass; share of the pairs at the
threshold that the trees may miss, and the sketches as well."""
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SEEDS = mixed(np.arange(1, 2 * BITS + 1, dtype=np.uint64)).astype(np.uint32)
_FLIP, _ODD = _SEEDS[:BITS], _SEEDS[BITS:] | np.uint32(1)


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = word_hashes(text.encode("utf-8", "surrogatepass").translate(_LOWER))
    return np.unique(shingle_hashes(words, size))


def minima(found: np.ndarray) -> np.ndarray:
    """The smallest value of a set under each of ``BITS`` hash functions, well mixed."""
    low = (found & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out, room = np.full(BITS, 0xFFFFFFFF, dtype=np.uint32), np.empty((128, BITS), dtype=np.uint32)
    for k in range(0, len(low), len(room)):
        part = low[k:k + len(room), None]
        value = np.bitwise_xor(part, _FLIP, out=room[:len(part)])
        value *= _ODD
        np.minimum(out, value.min(axis=0), out=out)
    return mixed(out.astype(np.uint64) + (np.arange(BITS, dtype=np.uint64) << np.uint64(32)))


def _sketched(batch: pa.RecordBatch, size: int) -> dict:
    out: dict[str, list] = {k: [] for k in ("id", "n", "d1", "d2", "sketch", "tokens")}
    for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
        found = shingles(text or "", size)
        row = (i, len(found), None, None, None, None)
        if len(found):
            digest = xxhash.xxh3_128_intdigest(found.tobytes())
            value = minima(found)
            row = (i, len(found), (digest & (1 << 64) - 1) - (1 << 63), (digest >> 64) - (1 << 63),
                   np.packbits((value & np.uint64(1)).astype(np.uint8)).tobytes(),
                   (value[:TREES * COORDINATES] >> np.uint64(40)).astype("<u2").tobytes())
        for column, x in zip(out.values(), row):
            column.append(x)
    return out


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(id, n, d1, d2, sketch, tokens) per row of ``docs`` (id, text): set size, digest of the set, 1-bit sketch, tokens."""
    return map_batches(docs, lambda: lambda batch: _sketched(batch, size), "id bigint, n bigint, d1 bigint, d2 bigint, sketch binary, tokens binary")


def widest(threshold: float) -> int:
    """The most differing sketch bits of a pair at ``threshold``, but for a share of ``MISSED`` of such pairs."""
    p, bits, within = (1 - threshold) / 2, 0, (1 - (1 - threshold) / 2) ** BITS
    while bits < BITS and 1 - within > MISSED:
        bits += 1
        within += math.comb(BITS, bits) * p ** bits * (1 - p) ** (BITS - bits)
    return bits


def missed(threshold: float, second: int, branchings: int = COORDINATES // 2 - 1) -> float:
    """Share of the pairs at ``threshold`` that meet in no tree if all their nodes branch to the last level."""
    met = 1.0
    for _ in range(branchings):
        apart = 1 - threshold * met
        met = 1 - (apart * (16 - second) + apart * apart * second) / 16
    return (1 - threshold * met) ** TREES


def second_children(threshold: float) -> int:
    """Of 16 nodes, how many branch into two children: as few as keep ``missed`` at ``MISSED``, all at low thresholds."""
    return next((k for k in range(16) if missed(threshold, k) <= MISSED), 16)


# --- trees ------------------------------------------------------------------------------------------------------

def _matrix(column: pa.Array, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), width)


def _children(node: np.ndarray, level: np.ndarray, path: np.ndarray, second: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node) of every row: one child, and another one in ``second`` of 16 nodes."""
    two = mixed(node ^ np.uint64(0x5DEECE66D)) >> np.uint64(60) < second
    rows = np.concatenate([np.arange(len(node)), np.flatnonzero(two)])
    which = np.concatenate([np.zeros(len(node), dtype=np.int64), np.ones(int(two.sum()), dtype=np.int64)])
    token = path[rows, 2 * level[rows] + which].astype(np.uint64)
    return rows, mixed(mixed(node[rows] + which.astype(np.uint64)) ^ token)


def _split(node, label, path, level, leaf: int, second: int):
    """Per level (node, row) of the nodes that fit a leaf and of the larger ones without a token left, both sorted by node.

    Nodes of one label are left out, their sets are connected.
    """
    row, last = np.arange(len(node)), path.shape[1] // 2
    while len(row):
        order = np.argsort(node, kind="stable")
        node, row, level = node[order], row[order], level[order]
        first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        count = np.diff(np.concatenate((first, [len(node)])))
        of_node = label[row]
        several = np.repeat(np.minimum.reduceat(of_node, first) != np.maximum.reduceat(of_node, first), count)
        large = several & (np.repeat(count, count) > leaf)
        small, packed = several & ~large, large & (level >= last)
        yield node[small], row[small], node[packed], row[packed]
        on = large & ~packed
        node, row, level = node[on], row[on], level[on]
        if len(row):
            picked, child = _children(node, level, path[row], second)
            node, row, level = child, row[picked], level[picked] + 1


def _pairs_of_leaves(node, row, label, size, sketch, threshold: float, leaf: int):
    """Places (i, j) of the pairs of different labels in small nodes, sorted by node, whose sizes and sketches are near."""
    limit = widest(threshold)
    for s in range(1, leaf):
        left = np.flatnonzero(node[:-s] == node[s:])
        if not len(left):
            break
        for k in range(0, len(left), 1 << 17):
            at = left[k:k + (1 << 17)]
            i, j = row[at], row[at + s]
            fits = (np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9) & (label[i] != label[j])
            at, i, j = at[fits], i[fits], j[fits]
            near = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64) <= limit
            yield at[near], at[near] + s


def _pairs_of_node(row, label, size, sketch, threshold: float, rows: int = 64):
    """(row, row) of all pairs of different labels in one large node whose sizes and sketches are near."""
    limit = widest(threshold)
    _, of_label, count = np.unique(label[row], return_inverse=True, return_counts=True)
    order = np.lexsort((of_label, -count[of_label]))
    row, of_label = row[order], of_label[order]
    end = np.concatenate((np.flatnonzero(of_label[1:] != of_label[:-1]) + 1, [len(row)]))
    words, sizes = np.ascontiguousarray(sketch[row].T), size[row].astype(np.float64)
    k = 0
    while k < len(row):
        stop = min(k + rows, len(row))
        start = int(end[np.searchsorted(end, k, "right")])
        if start < stop:
            start = k
        differ = np.zeros((stop - k, len(row) - start), dtype=np.uint16)
        for word in words:
            differ += np.bitwise_count(word[k:stop, None] ^ word[None, start:])
        i, j = np.nonzero(differ <= limit)
        i, j = i + k, j + start
        fits = (i < j) & (of_label[i] != of_label[j]) & (
            np.minimum(sizes[i], sizes[j]) >= threshold * np.maximum(sizes[i], sizes[j]) - 1e-9)
        yield row[i[fits]], row[j[fits]]
        k = stop


def _tiles(i: np.ndarray, j: np.ndarray, node: np.ndarray, leaf: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, row) that hold every pair (i, j): a connected group as one leaf, a larger one in tiles of two blocks."""
    pair = np.unique(np.minimum(i, j) * len(node) + np.maximum(i, j))
    rows, flat = np.unique(np.concatenate([pair // len(node), pair % len(node)]), return_inverse=True)
    a, b = flat.reshape(2, -1)
    group = np.arange(len(rows))
    while (group[a] != group[b]).any():
        x, y = group[a], group[b]
        np.minimum.at(group, np.maximum(x, y), np.minimum(x, y))
        while (group[group] != group).any():
            group = group[group]
    order = np.argsort(group, kind="stable")
    place = np.empty(len(rows), dtype=np.int64)
    place[order] = np.arange(len(rows)) - np.searchsorted(group[order], group[order], "left")
    block = (place // leaf).astype(np.uint64)
    of_group = mixed(mixed(node[rows[group]] + np.uint64(turn)) + rows[group].astype(np.uint64))
    low, high = np.minimum(block[a], block[b]), np.maximum(block[a], block[b])
    tile = mixed(of_group[a] + (low << np.uint64(32)) + high)
    tile, row = np.concatenate([tile, tile]), rows[flat]
    order = np.lexsort((row, tile))
    tile, row = tile[order], row[order]
    new = np.concatenate(([True], (tile[1:] != tile[:-1]) | (row[1:] != row[:-1])))
    return tile[new].view(np.int64), row[new]


def candidate_leaves(node, label, size, sketch, path, level, threshold: float, leaf: int = LEAF, held: int = 1 << 22):
    """(leaf, row) of the sets with a candidate partner of another label, a pair's two sets in one leaf.

    Nodes are split until they fit a leaf or no token is left; both kinds are compared exhaustively, whatever their size.
    """
    pairs, n, turn, second = [], 0, 0, second_children(threshold)

    def found():
        for at_node, at_row, packed, packed_row in _split(node, label, path, level, leaf, second):
            for x, y in _pairs_of_leaves(at_node, at_row, label, size, sketch, threshold, leaf):
                yield at_row[x], at_row[y]
            bounds = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1], [True]))) if len(packed) else []
            for x, y in zip(bounds[:-1], bounds[1:]):
                yield from _pairs_of_node(packed_row[x:y], label, size, sketch, threshold)

    for pair in found():
        pairs.append(pair)
        n += len(pair[0])
        if n >= held:
            yield _tiles(*map(np.concatenate, zip(*pairs)), node, leaf, turn)
            pairs, n, turn = [], 0, turn + 1
    if n:
        yield _tiles(*map(np.concatenate, zip(*pairs)), node, leaf, turn)


def first_leaves(node, label, size, sketch, path, level, threshold: float, leaf: int = LEAF):
    """(leaf, row) of sets with a candidate partner, found in one pass whose leaves overlap little.

    Only for connecting large groups early: nodes don't branch, and what doesn't fit a leaf at the end is cut into leaves
    that share the node's first set. The pairs that this leaves out are met by ``candidate_leaves``.
    """
    for at_node, at_row, packed, packed_row in _split(node, label, path, level, leaf, 0):
        if len(packed):
            start = np.searchsorted(packed, packed, "left")
            block = mixed(packed + ((np.arange(len(packed)) - start) // (leaf - 1)).astype(np.uint64))
            blocks, one = np.unique(block, return_index=True)
            pair = np.stack([np.concatenate([block, blocks]), np.concatenate([packed_row, packed_row[start[one]]]).astype(np.uint64)], axis=1)
            pair = np.unique(pair, axis=0)
            at_node, at_row = np.concatenate([at_node, pair[:, 0]]), np.concatenate([at_row, pair[:, 1].astype(np.int64)])
            order = np.argsort(at_node, kind="stable")
            at_node, at_row = at_node[order], at_row[order]
        marked = np.zeros(len(at_node), dtype=bool)
        for x, y in _pairs_of_leaves(at_node, at_row, label, size, sketch, threshold, leaf):
            marked[x] = marked[y] = True
        yield at_node[marked].view(np.int64), at_row[marked]


_NODE_COLUMNS = ("node", "level", "id", "label", "n", "sketch", "path")


def _grouped(batches, key: str, rows: int):
    """Tables of whole groups of the sorted column ``key``, of about ``rows`` rows or one group."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            table = pa.Table.from_batches(held)
            keys = table.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            if cut:
                yield table.slice(0, cut).combine_chunks()
                held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _dealt(rows: DataFrame, spent: DataFrame, part_rows: int) -> DataFrame:
    """First pass only: nodes without tokens left dealt into parts, anew in each node, that share four of its sets."""
    parts = F.ceil(F.col("rows") / part_rows).cast("int").alias("parts")
    dealt = rows.join(spent.select("node", parts), "node").withColumn(
        "node", F.xxhash64("node", F.pmod(F.xxhash64("id", "node"), F.col("parts")).cast("int")))
    pivots = spent.select("node", F.explode(F.array_distinct(F.array(*[f"pivot{k}" for k in range(4)]))).alias("id"), parts)
    pivots = rows.join(pivots, ["node", "id"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select(*_NODE_COLUMNS).unionByName(pivots.withColumn("node", F.xxhash64("node", "part")).select(*_NODE_COLUMNS))


def _all_tiles(rows: DataFrame, spent: DataFrame, part_rows: int) -> DataFrame:
    """Nodes without tokens left in tiles of two parts each, so that every pair of different labels shares a tile.

    The sets of a node's most frequent label don't meet each other, so they are written once for each part of the others.
    """
    inside = rows.join(spent.select("node"), "node")
    counts = staged(inside.groupBy("node", "label").agg(F.count(F.lit(1)).alias("rows")), "labels")
    most = counts.groupBy("node").agg(
        F.max(F.struct("rows", "label")).alias("top"), F.sum("rows").alias("all")).select(
        "node", F.col("top.label").alias("top"), F.ceil(F.col("top.rows") / part_rows).cast("int").alias("of_top"),
        F.ceil((F.col("all") - F.col("top.rows")) / part_rows).cast("int").alias("of_rest"))
    inside = inside.join(most, "node").withColumn("is_top", F.col("label") == F.col("top"))
    part = F.pmod(F.xxhash64("id", "node"), F.when(F.col("is_top"), F.col("of_top")).otherwise(F.col("of_rest"))).cast("int")
    inside = inside.withColumn("part", part)
    each_rest, each_top = (F.sequence(F.lit(0), F.col(c) - 1) for c in ("of_rest", "of_top"))
    with_top = F.transform(F.when(F.col("is_top"), each_rest).otherwise(each_top), lambda k: F.xxhash64(
        "node", F.when(F.col("is_top"), k).otherwise(F.col("part")), F.lit("top"), F.when(F.col("is_top"), F.col("part")).otherwise(k)))
    with_rest = F.transform(each_rest, lambda k: F.xxhash64("node", F.least("part", k), F.lit("rest"), F.greatest("part", k)))
    tiles = F.when(F.col("is_top"), with_top).otherwise(F.concat(with_top, with_rest))
    return inside.withColumn("node", F.explode(tiles))


def _split_large(rows: DataFrame, node_rows: int, whole: bool, second: int) -> DataFrame:
    """Nodes of more than ``node_rows`` rows branched on the cluster until every node fits a task. Nodes of one label go."""
    last = COORDINATES // 2
    while True:
        sizes = staged(rows.groupBy("node").agg(
            F.count(F.lit(1)).alias("rows"), F.min("level").alias("at"), (F.min("label") != F.max("label")).alias("several"),
            *[F.min_by("id", F.xxhash64("id", "node", F.lit(k))).alias(f"pivot{k}") for k in range(4)]
        ).where(F.col("rows") > node_rows), "nodes")
        if sizes.isEmpty():
            return rows
        rows = staged(rows, "rows")
        small = rows.join(sizes.select("node"), "node", "left_anti")
        sizes = sizes.where("several")
        large = rows.join(sizes.select("node", "at"), "node")
        two = F.pmod(F.xxhash64("node", F.lit("two")), F.lit(16)) < second
        which = F.explode(F.when(two, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        split = large.where(F.col("at") < last).withColumn("which", which)
        token = F.substring(F.col("path"), (F.col("level") * 2 + F.col("which")) * 2 + 1, F.lit(2))
        split = split.withColumn("node", F.xxhash64("node", "which", token)).withColumn("level", F.col("level") + 1)
        out = small.select(*_NODE_COLUMNS).unionByName(split.select(*_NODE_COLUMNS))
        spent = sizes.where(F.col("at") >= last)
        if not spent.isEmpty():
            made = _all_tiles(rows, spent, node_rows // 2) if whole else _dealt(rows, spent, node_rows // 2)
            return out.unionByName(made.select(*_NODE_COLUMNS))
        rows = out


def leaves(found: DataFrame, threshold: float, node_rows: int = NODE_ROWS, leaf: int = LEAF, trees: int = TREES, whole: bool = True) -> DataFrame:
    """(leaf, id, label) of the sets that have a candidate partner of another label in a leaf.

    ``found``: id, n, sketch, tokens, label, one row per set. ``whole``: as ``candidate_leaves``, else as ``first_leaves``.
    """
    paths = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substring(
        F.col("tokens"), t * (2 * COORDINATES) + 1, F.lit(2 * COORDINATES))))
    rows = found.select("id", "label", "n", "sketch", paths.alias("tree", "path"))
    rows = rows.withColumn("node", F.xxhash64("tree", F.substring("path", 1, 2))).withColumn("level", F.lit(1))
    rows = _split_large(rows.select(*_NODE_COLUMNS), node_rows, whole, second_children(threshold) if whole else 0)

    def run(batches):
        for table in _grouped(batches, "node", 30_000):
            node = table.column("node").to_numpy().view(np.uint64)
            ids, label = table.column("id").to_numpy(), table.column("label").to_numpy()
            sketch = _matrix(table.column("sketch"), BITS // 64, "<u8")
            path = _matrix(table.column("path"), COORDINATES, "<u2")
            level, size = table.column("level").to_numpy().astype(np.int64), table.column("n").to_numpy()
            make = candidate_leaves if whole else first_leaves
            for leaf_of, row in make(node, label, size, sketch, path, level, threshold, leaf):
                yield pa.RecordBatch.from_arrays([pa.array(leaf_of), pa.array(ids[row]), pa.array(label[row])], ["leaf", "id", "label"])

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, "leaf bigint, id bigint, label bigint")


# --- confirmation -----------------------------------------------------------------------------------------------

def links_of_leaf(ids, labels, sets: list[np.ndarray], sketch: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links that connect the sets of a leaf as all its links would. Pairs already connected are skipped."""
    n, limit = len(ids), widest(threshold)
    seen: dict[int, int] = {}
    group = [seen.setdefault(x, i) for i, x in enumerate(labels)]
    sizes, out = np.array([len(s) for s in sets]), []
    percent = round(threshold * 100)

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    for i in range(n - 1):
        own = root(i)
        near = np.bitwise_count(sketch[i + 1:] ^ sketch[i]).sum(axis=1, dtype=np.int64) <= limit
        near &= np.minimum(sizes[i + 1:], sizes[i]) >= threshold * np.maximum(sizes[i + 1:], sizes[i]) - 1e-9
        others = [j for j in (np.flatnonzero(near) + i + 1).tolist() if root(j) != own]
        if not others:
            continue
        joint = np.concatenate([sets[j] for j in others])
        place = np.minimum(np.searchsorted(sets[i], joint), sizes[i] - 1)
        starts = np.concatenate(([0], np.cumsum(sizes[others])[:-1]))
        common = np.add.reduceat((sets[i][place] == joint).astype(np.int64), starts)
        for j, c in zip(others, common.tolist()):
            if 100 * c >= percent * (int(sizes[i]) + int(sizes[j]) - c):
                a, b = root(i), root(j)
                if a != b:
                    group[max(a, b)] = min(a, b)
                    out.append((int(ids[i]), int(ids[j])))
    return out


def confirmed(rows: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) found in the leaves of ``rows`` (leaf, id, label); ``sets``: id, sketch, found (the set's bytes)."""
    whole = rows.join(sets, "id").repartition("leaf").sortWithinPartitions("leaf", "id")

    def run(batches):
        for table in _grouped(batches, "leaf", 64):
            leaf = table.column("leaf").to_numpy()
            ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
            sketch = _matrix(table.column("sketch"), BITS // 64, "<u8")
            sets = [np.frombuffer(x, dtype="<u8") for x in table.column("found").to_pylist()]
            bounds = np.flatnonzero(np.concatenate(([True], leaf[1:] != leaf[:-1], [True])))
            out = [x for a, b in zip(bounds[:-1], bounds[1:])
                   for x in links_of_leaf(ids[a:b], labels[a:b], sets[a:b], sketch[a:b], threshold)]
            if out:
                a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return whole.select("leaf", "id", "label", "sketch", "found").mapInArrow(run, "a bigint, b bigint")


def _sets(rows: DataFrame, reps: DataFrame, found: DataFrame, size: int) -> DataFrame:
    """(id, sketch, found) of the sets in ``found`` (leaf, id), made again from the texts of ``rows`` (id, text)."""
    ids = staged(found.select("id").distinct(), "ids")
    needed = reps.join(ids, "id", "left_semi").select("id", "d1", "d2", "sketch").distinct()
    texts = rows.where(F.col("id").isNotNull()).join(ids.hint("shuffle_hash"), "id", "left_semi")

    def make():
        def body(batch):
            found = [shingles(t or "", size) for t in batch.column("text").to_pylist()]
            digests = [xxhash.xxh3_128_intdigest(f.tobytes()) for f in found]
            return {"id": batch.column("id"), "d1": [(d & (1 << 64) - 1) - (1 << 63) for d in digests],
                    "d2": [(d >> 64) - (1 << 63) for d in digests], "found": [f.tobytes() for f in found]}
        return body

    sets = map_batches(texts, make, "id bigint, d1 bigint, d2 bigint, found binary")
    return staged(sets.join(needed, ["id", "d1", "d2"]).select("id", "sketch", "found"), "sets")


def _links_of_ids(made: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) from an id whose rows have different sets to the smallest ids of the classes of these sets."""
    rows = made.where(F.col("id").isNotNull()).select("id", "d1", "d2")
    of_set = F.struct(F.coalesce("d1", F.lit(0)), F.coalesce("d2", F.lit(0)))
    several = rows.groupBy("id").agg(F.min(of_set).alias("x"), F.max(of_set).alias("y")).where("x != y").select("id")
    own = rows.join(several, "id", "left_semi").distinct().join(classes, ["d1", "d2"])
    return own.where(F.col("rep") != F.col("id")).select(F.col("rep").alias("a"), F.col("id").alias("b"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8,
    node_rows: int = NODE_ROWS, leaf: int = LEAF,
) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id reachable by links), kept (id = component_id).

    A set is the distinct runs of ``size`` words (A-Z lowered, split at ASCII white space), or the whole sequence where
    there are fewer words. Two documents are linked if their Jaccard similarity reaches ``threshold``, in whole percent,
    computed on the full sets. Equal sets form a class and only its smallest id goes through the trees. Null texts and
    texts without words have no set and no links. Rows that repeat an id share one component, also where their texts differ,
    so all of them are kept or none. A row without id has no
    component and is kept. Large classes and groups are never expanded into pairs.

    Of the pairs at the threshold, the trees miss at most one in 10,000 (``MISSED``) if all 9 branchings are needed, as
    computed by ``missed``, and the sketches another one in 10,000, by the binomial distribution of their bits. Below a
    threshold of about 0.69 the trees miss more: ``missed(threshold, 16)``. Pairs above the threshold are missed less, and
    a group is joined by any of its links. Nodes without a token left are compared whole, so their cost grows with the
    square of the sets that the first pass leaves unconnected there.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    made = staged(sketches(rows, size), "sketches")
    usable = made.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = staged(usable.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.max("id").alias("last")), "classes")
    reps = usable.join(classes.select("d1", "d2", F.col("rep").alias("id")), ["d1", "d2", "id"])
    reps = staged(reps.select("id", "n", "d1", "d2", "sketch", "tokens"), "reps")
    early = staged(leaves(reps.withColumn("label", F.col("id")), threshold, node_rows, leaf, FIRST_TREES, whole=False), "leaves")
    first = staged(confirmed(early, _sets(rows, reps, early, size), threshold), "links")
    known = components(first)
    labelled = reps.join(known, "id", "left").withColumn("label", F.coalesce("component", "id"))
    late = staged(leaves(labelled, threshold, node_rows, leaf), "leaves")
    second = staged(confirmed(late, _sets(rows, reps, late, size), threshold), "links")
    joined = staged(components(first.unionByName(second).unionByName(_links_of_ids(made, classes))), "components")

    several = classes.where(F.col("rep") != F.col("last")).select("d1", "d2", "rep")
    out = made.select("id", "n", "d1", "d2").join(several, ["d1", "d2"], "left")
    out = out.select("id", "n", F.coalesce("rep", "id").alias("rep"))
    linked = out.join(joined.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
        "id", "n", F.coalesce("component", "rep").alias("component"))
    return _one_component_per_id(linked, id_col)


def _one_component_per_id(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
