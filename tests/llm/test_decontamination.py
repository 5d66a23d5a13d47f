"""Greedy string tiling against a version that looks for every longest match again."""

import random
import time
import tracemalloc

import duckdb
import numpy as np
import pytest

from panelforge.llm import queries
from panelforge.llm.decontamination import Items, coverage, decontaminate, plain
from panelforge.llm.text import word_hashes

def tokens(text):
    return plain(text).split()


SF = "/root/testdata/sf0.01"


def slow_coverage(doc, item, size):
    size = min(size, len(item))
    marked_d, marked_i, total = [False] * len(doc), [False] * len(item), 0
    while True:
        best = None
        for a in range(len(doc)):
            for b in range(len(item)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and not marked_d[a + n] and not marked_i[b + n]:
                    n += 1
                if n >= size and (best is None or (-n, a, b) < best):
                    best = (-n, a, b)
        if best is None:
            return total / len(item)
        n, a, b = -best[0], best[1], best[2]
        marked_d[a:a + n] = [True] * n
        marked_i[b:b + n] = [True] * n
        total += n


def test_tiling_equals_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        words = [b"%d" % i for i in range(rng.choice([2, 4, 12]))]
        item = [rng.choice(words) for _ in range(rng.randint(1, 25))]
        doc = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.7:
            cut = rng.randint(0, len(item))
            doc += item[cut:] + [b"z"] * rng.randint(0, 2) + item[:cut]
        size = rng.choice([1, 2, 3, 5])
        got = dict(coverage(word_hashes(b' '.join(doc)), Items([(0, word_hashes(b' '.join(item)))], size)))
        assert got.get(0, 0.0) == pytest.approx(slow_coverage(doc, item, size)), (doc, item, size)


ITEM = "the quick brown fox jumps over the lazy dog while seven grey cats watch from a wall"
BENCH = [(7, ITEM), (7, ITEM), (8, None), (9, ""), (10, "tiny item"), (None, ITEM), (11, "...")]


def test_edges_and_reordered_passages(spark):
    half = ITEM.split()
    docs = [
        (1, f"Before. {ITEM.upper()}! After"), (2, " ".join(half[8:]) + " filler words here " + " ".join(half[:8])),
        (3, " ".join(half[:6])), (4, None), (5, ""), (6, "a tiny item here"), (None, ITEM), (1, "clean"), (8, ("word " * 30_000) + ITEM),
    ]
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, items string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    for block in (2_000_000, 1):
        rows = decontaminate(df, bench, block_tokens=block, carry=("text",)).collect()
        got = sorted((r.doc_id or 0, r.contaminated, tuple(r.items)) for r in rows)
        assert got == [(0, True, (7,)), (1, False, ()), (1, True, (7,)), (2, True, (7,)), (3, False, ()), (4, False, ()),
                       (5, False, ()), (6, True, (10,)), (8, True, (7,))]
    assert decontaminate(df, bench.limit(0)).where("contaminated or best_coverage > 0").count() == 0
    assert decontaminate(df.limit(0), bench).count() == 0


@pytest.mark.parametrize("n, m", [(20_000, 500), (40_000, 1_000)])
def test_repeated_tokens_take_little_memory(n, m):
    doc, item = word_hashes(b"a " * n), word_hashes(b"a " * m)
    tracemalloc.start()
    start = time.perf_counter()
    assert coverage(doc, Items([(0, item)], 5)) == [(0, 1.0)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 * n and time.perf_counter() - start < 3
    mixed = word_hashes(b" ".join(b"%d" % (i % 7) for i in range(n)))
    assert coverage(mixed, Items([(0, word_hashes(b" ".join(b"%d" % (i % 5) for i in range(m))))], 3))[0][1] > 0.9


def test_query_equals_brute_force(spark):
    bench = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    docs = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    got = {r.doc_id: r for r in queries.op2_decontamination(spark, SF).collect()}
    assert set(got) == set(docs)
    whole = {i: " " + " ".join(x.decode() for x in tokens(t)) + " " for i, t in bench}
    for d, t in docs.items():
        text = " " + " ".join(x.decode() for x in tokens(t)) + " "
        verbatim = sorted(i for i, w in whole.items() if w in text)
        assert set(verbatim) <= set(got[d].items), d
    hits = [d for d in docs if got[d].best_coverage > 0]
    items = {i: tokens(t) for i, t in bench}
    def grams(words, n):
        return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}

    known = {i: grams(w, min(5, len(w))) for i, w in items.items()}
    for d in docs:  # every item that shares five words, reported or not
        words = tokens(docs[d])
        mine = {n: grams(words, n) for n in {min(5, len(w)) for w in items.values()} if n}
        want = {i: slow_coverage(words, w, 5) for i, w in items.items() if w and known[i] & mine[min(5, len(w))]}
        assert max(want.values(), default=0.0) == pytest.approx(got[d].best_coverage), d
        assert list(got[d].items) == sorted(i for i, c in want.items() if c >= 0.5), d
    assert len(hits) > 20
