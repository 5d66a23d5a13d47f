"""Benchmark passages in documents, found by greedy string tiling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..sources.staging import staged
from .text import per_text, shingle_hashes, text_of, word_hashes

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
MIN_MATCH, COVERAGE, BLOCK_TOKENS = 5, 0.5, 2_000_000


def plain(text: str) -> bytes:
    """A text without ASCII punctuation, A-Z in lower case; its words are the tokens."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER, _MARKS)


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n, base, dtype=np.uint64)]))


class Items:
    """A block of benchmark items: token hashes, and the distinct seeds (hashes of ``min_match`` tokens in a row) of each, sorted."""

    def __init__(self, items: list[tuple[int, np.ndarray]], min_match: int):
        self.ids = [i for i, _ in items]
        self.tokens = [t for _, t in items]
        self.min_match = min_match
        # A short item is one seed of its own length, and is looked for at that length.
        self.sizes = sorted({min(min_match, len(t)) for t in self.tokens})
        self.seeds = {}
        for size in self.sizes:
            found = [(np.unique(shingle_hashes(t, size)), n) for n, t in enumerate(self.tokens) if min(min_match, len(t)) == size]
            h = np.concatenate([f for f, _ in found])
            item = np.repeat(np.array([n for _, n in found], dtype=np.int32), [len(f) for f, _ in found])
            order = np.argsort(h, kind="stable")
            self.seeds[size] = h[order], item[order]

    def shared(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """The join of seeds: item -> places in the document whose seed the item has, rising; a place once an item."""
        out: dict[int, np.ndarray] = {}
        for size, (known, item) in self.seeds.items():
            if len(words) < size:
                continue
            h = shingle_hashes(words, size)
            low = np.searchsorted(known, h, "left")
            hit = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == h)
            if not len(hit):
                continue
            n = np.searchsorted(known, h[hit], "right") - low[hit]
            at = np.repeat(low[hit] - np.cumsum(n) + n, n) + np.arange(n.sum())
            where, which = np.repeat(hit, n), item[at]
            order = np.argsort(which, kind="stable")
            cut = np.flatnonzero(np.diff(which[order])) + 1
            for part in np.split(order, cut):
                out[int(which[part[0]])] = where[part]
        return out


class _Marked:
    """Tokens of which some are marked. Running sums give the hash of any window, and whether it is free, in one step."""

    def __init__(self, words: np.ndarray, place: np.ndarray, powers: np.ndarray, inverse: np.ndarray):
        self.words, self.place, self.inverse = words, place, inverse
        self.free = np.ones(len(words), dtype=bool)
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * powers[:len(words)], dtype=np.uint64)])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where ``size`` free tokens stand next to each other, and their hashes."""
        n = len(self.words) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        taken = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero((taken[size:] == taken[:n]) & (self.place[size - 1:] - self.place[:n] == size - 1))
        return at, (self.sums[at + size] - self.sums[at]) * self.inverse[at]


def tiles(doc: np.ndarray, item: np.ndarray, where: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the document, place in the item, length) of ``size`` tokens or more; none overlap.

    The longest run that is free in both texts is marked, the first one in the document and then in the item if there
    are several, and so on. A length is tried by comparing the hashes of all free windows of that length (Karp-Rabin);
    runs contain shorter runs, so the longest is found by halving, and no run is longer than the one marked before. A
    run is compared token by token before it is marked. ``where`` are the places of shared seeds: only tokens in one can
    be matched. Memory is that of the tokens, whatever repeats in them.
    """
    reach = np.zeros(len(doc) + 1, dtype=np.int64)
    np.add.at(reach, where, 1)
    np.add.at(reach, np.minimum(where + size, len(doc)), -1)
    place = np.flatnonzero(np.cumsum(reach[:-1]) > 0)
    n = max(len(place), len(item))
    powers, inverse = _powers(_BASE, n), _powers(_INVERSE, n)
    left = _Marked(doc[place], place, powers, inverse)
    right = _Marked(item, np.arange(len(item)), powers, inverse)

    def common(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        a, ha = left.windows(length)
        b, hb = right.windows(length)
        hit = np.isin(ha, hb)
        return (a[hit], ha[hit], b, hb) if hit.any() else None

    out, longest = [], min(len(place), len(item))
    while longest >= size:
        found = common(longest)
        if found is None:
            low, high = size - 1, longest
            while high - low > 1:
                middle = (low + high) // 2
                if common(middle) is None:
                    high = middle
                else:
                    low = middle
            longest = low
            continue
        a, ha, b, hb = found
        start, there = int(a[0]), int(b[hb == ha[0]][0])
        ends = slice(start, start + longest), slice(there, there + longest)
        left.free[ends[0]] = right.free[ends[1]] = False
        if (left.words[ends[0]] == right.words[ends[1]]).all():
            out.append((int(place[start]), there, longest))
    return out


def coverage(words: np.ndarray, items: Items) -> list[tuple[int, float]]:
    """(item, share of its tokens in tiles) for the items that share a seed with the document."""
    out = []
    for item, where in items.shared(words).items():
        tokens = items.tokens[item]
        found = tiles(words, tokens, where, min(items.min_match, len(tokens)))
        out.append((item, sum(n for _, _, n in found) / len(tokens)))
    return out


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, min_match: int, block_tokens: int) -> Iterator[Items]:
    """The benchmark in blocks of at most ``block_tokens`` tokens (one item at least), read one after another.

    The driver holds one block at a time.
    """
    sizes = benchmark.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    block, held = [], 0
    for row in sizes.orderBy("id", "text").toLocalIterator():
        words = word_hashes(plain(row.text))
        if not len(words):
            continue
        if block and held + len(words) > block_tokens:
            yield Items(block, min_match)
            block, held = [], 0
        block.append((row.id, words))
        held += len(words)
    if block:
        yield Items(block, min_match)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", min_match: int = MIN_MATCH, threshold: float = COVERAGE, block_tokens: int = BLOCK_TOKENS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Per row: id, contaminated, items (ids whose coverage reaches ``threshold``), best_item, best_coverage, ``carry``.

    Tokens are words without ASCII punctuation, A-Z lowered. A document and an item that share a run of ``min_match``
    tokens are tiled: the longest common runs first, none overlapping, so a passage whose parts were moved counts in
    full. Coverage is the share of the item's tokens in tiles; at equal coverage the smallest id is the best item.
    Items shorter than ``min_match`` must occur whole. Null or empty texts on either side share nothing; items that
    repeat count once per id. Every document is judged alone, so repeated rows and null ids are kept as they are.

    The benchmark goes to the executors in blocks of ``block_tokens`` tokens, 24 bytes each, whatever its size. The
    documents pass by the blocks without an exchange, each block in a pass of its own that is staged, so that a worker
    holds one block; a benchmark of one block needs one pass and no staging.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("__id"), text_of(text_col).alias("__text"), *[F.col(c).alias(f"__rest_{c}") for c in carry])
    names = []
    for tests in benchmark_blocks(benchmark, item_id, item_text, min_match, block_tokens):
        if names:
            rows = staged(rows, "tiled")
        shared = spark.sparkContext.broadcast(tests)

        def make(shared=shared):
            tests = shared.value

            def one(text):
                best, over = (0.0, None), set()
                for item, share in coverage(word_hashes(plain(text)), tests):
                    if share >= threshold:
                        over.add(tests.ids[item])
                    if share > best[0] or share == best[0] and best[1] is not None and tests.ids[item] < best[1]:
                        best = share, tests.ids[item]
                return {"items": sorted(over), "best_coverage": best[0], "best_item": best[1]}

            def body(texts):
                rows = [one(t) for t in texts]
                return {k: [r[k] for r in rows] for k in ("items", "best_coverage", "best_item")}
            return body

        kind = "struct<items:array<bigint>,best_coverage:double,best_item:bigint>"
        found = f"__found_{len(names)}"
        rows = rows.withColumn(found, per_text(F.col("__text"), make, kind, spark))
        names.append(F.col(found))
    items = F.array_sort(F.array_distinct(F.concat(*[c["items"] for c in names]))) if names else F.array().cast("array<bigint>")
    best = F.lit(None).cast("struct<best_coverage:double,minus:bigint,best_item:bigint>")
    if names:
        best = F.array_max(F.array(*[F.struct(c["best_coverage"], (-c["best_item"]).alias("minus"), c["best_item"]) for c in names]))
    rows = rows.select(
        F.col("__id").alias(id_col), items.alias("items"), best.alias("__best"), *[F.col(f"__rest_{c}").alias(f"__rest_{c}") for c in carry])
    return rows.select(
        id_col, (F.size("items") > 0).alias("contaminated"), "items", F.col("__best")["best_item"].alias("best_item"),
        F.coalesce(F.col("__best")["best_coverage"], F.lit(0.0)).alias("best_coverage"),
        *[F.col(f"__rest_{c}").alias(c) for c in carry])
