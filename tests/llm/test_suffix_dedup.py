"""Removed repeats against a dictionary of all strings; the sorter against sorted()."""

import random
import re
import tracemalloc

import duckdb
import numpy as np
import pytest

import brute
from helpers import plan_of
from panelforge.llm import queries, suffix_dedup, suffix_sort
from panelforge.llm.suffix_dedup import remove_repeats, repeated_windows, segments
from panelforge.llm.suffix_sort import DiskQueue, suffix_order

SF = "/root/testdata/sf0.01"


def brute_repeats(rows, length):
    seen = {}
    data = [(t or "").encode() for _, t in rows]
    for d in data:
        for i in range(len(d) - length + 1):
            w = hash(d[i:i + length])
            seen[w] = seen.get(w, 0) + 1
    out = []
    for (i, _), d in zip(rows, data):
        gone = np.zeros(len(d) + 1, dtype=np.int64)
        for k in range(len(d) - length + 1):
            if seen[hash(d[k:k + length])] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(d, dtype=np.uint8)[~gone].tobytes()
        out.append((i, len(d), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), brute.sha(kept)))
    return sorted(out, key=str)


def result(df):
    return sorted([tuple(r)[:5] for r in df.collect()], key=str)


def shared(a, b, most):
    return next((k for k in range(min(len(a), len(b), most)) if a[k] != b[k]), min(len(a), len(b), most))


@pytest.mark.parametrize("memory", [1 << 30, 4096, 64])
def test_suffix_order_and_common_prefixes(memory):
    rng = random.Random(1)
    for _ in range(150):
        text = bytes(rng.choice(b"abc"[:rng.randint(1, 3)]) for _ in range(rng.randint(1, 60))) * rng.choice([1, 1, 2, 4])
        depth = rng.choice([5, 60, len(text)])
        order, prefixes = suffix_order(np.frombuffer(text, dtype=np.uint8), depth, memory)
        cut = [text[i:i + depth] for i in order.tolist()]
        assert sorted(order.tolist()) == list(range(len(text))) and cut == sorted(cut)
        assert prefixes.tolist() == [0] + [shared(a, b, depth) for a, b in zip(cut, cut[1:])]


def test_shard_many_times_the_memory():
    """Twice the text takes no more memory; recursion and runs on disk are used, and the order is that of one piece."""
    rng = random.Random(4)
    words = [bytes(rng.choice(b"etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    memory, depths, spilled, peaks = 100_000, [], [], []
    inner, spill = suffix_sort.suffix_order, suffix_sort.DiskQueue.spill
    for n in (30_000, 60_000):
        text = np.frombuffer(b" ".join(rng.choice(words) for _ in range(n)), dtype=np.uint8)
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(suffix_sort, "suffix_order", lambda t, d, m: depths.append(d) or inner(t, d, m))
            patch.setattr(suffix_sort.DiskQueue, "spill", lambda q: spilled.append(q.held) or spill(q))
            patch.setattr(suffix_sort, "_BLOCK", 1 << 9)
            tracemalloc.start()
            got, prefixes = suffix_sort.suffix_order(text, 200, memory)
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
        want, want_prefixes = inner(text, 200)
        assert (got == want).all() and (prefixes == want_prefixes).all()
    assert len(depths) >= 4 and len(spilled) > 50 and max(spilled) < 2 * memory
    assert 9 * len(text) > 30 * memory and peaks[1] < 1.2 * peaks[0], (peaks, len(text))


def test_queue_is_first_in_first_out():
    rng, queue, waiting = np.random.default_rng(0), DiskQueue(500), {}
    key = n = 0
    while n < 3000 or waiting:
        if n < 3000:
            keys = np.sort(rng.integers(key, key + 20, 30))
            for k, place in zip(keys.tolist(), range(n, n + 30)):
                waiting.setdefault(k, []).append(place)
            queue.push(keys, np.arange(n, n + 30), np.zeros(30, dtype=np.int16))
            n += 30
        key = queue.next_key()
        assert key == min(waiting)
        for place in queue.pop(key, 7)[0].tolist():
            assert waiting[key].pop(0) == place
        if not waiting[key]:
            del waiting[key]
    assert queue.next_key() is None and len(queue.runs) > 5


def test_repeated_windows():
    rng = random.Random(2)
    for _ in range(60):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(8, 40))) for _ in range(rng.randint(1, 6))]
        windows = np.array([len(p) - 7 for p in parts])
        text = np.frombuffer(b"".join(p + b"\xff" for p in parts), dtype=np.uint8)
        count = {}
        for p, n in zip(parts, windows):
            for i in range(n):
                count[p[i:i + 8]] = count.get(p[i:i + 8], 0) + 1
        want = [i < n and count[p[i:i + 8]] > 1 for p, n in zip(parts, windows) for i in range(len(p) + 1)]
        assert repeated_windows(text, np.array([len(p) for p in parts]), windows, 8, 100).tolist() == want


def test_segments_cover_all_windows_and_depend_on_content():
    rng = random.Random(3)
    shared = bytes(rng.randrange(97, 123) for _ in range(900))
    for before in (b"", b"x" * 333):
        start, windows, gram, content, times = segments(before + shared)
        ends = start + windows * times
        assert start[0] == 0 and (start[1:] == ends[:-1]).all() and ends[-1] == len(before + shared) - 199
    a, b = segments(shared), segments(b"y" * 77 + shared)
    assert set(a[2].tolist()) <= set(b[2].tolist()) and len(set(a[3].tolist()) & set(b[3].tolist())) >= len(a[3]) - 2


@pytest.mark.parametrize("period", [b"a", b"ab", b"a line that repeats\n"])
def test_periodic_texts_make_few_segments(spark, period):
    data = period * (2_000_000 // len(period))
    assert len(segments(data)[0]) < 50
    rows = [(1, data.decode()), (2, "front " * 5 + data[:500].decode() + " and its end, which is not periodic at all"), (3, data[:150].decode())]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept == b"" and got[1].n_spans == 1 and got[1].n_removed == len(data)
    want = brute_repeats([(1, data[:3000].decode()), *rows[1:]], 200)
    assert tuple(got[2])[:5] == [w for w in want if w[0] == 2][0] and got[3].kept is None


@pytest.fixture(scope="module")
def crowd():
    rng = random.Random(5)

    def words(n):
        return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "éta", "theta"]) + str(rng.randint(0, 99)) for _ in range(n))

    passage, rows = words(90), []
    for i in range(60):
        rows.append((i, words(rng.randint(0, 80)) + " " + passage[:rng.randint(150, len(passage))] + words(rng.randint(0, 80))))
    base = words(200)
    for i in range(60, 90):
        at = rng.randint(0, len(base) - 1)
        rows.append((i, base[:at] + "#" + base[at + 1:]))
    rows += [(90, base), (91, base), (92, None), (93, ""), (94, "short"), (95, "ab" * 400), (96, "z" * 199), (97, "z" * 200), (98, "z" * 201),
             (90, words(60)), (None, base), (None, words(50)), (99, words(2000) + passage)]
    return rows


@pytest.mark.parametrize("shard", [6_000, 4, 1])
def test_equals_brute_force(spark, crowd, shard):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in crowd], "doc_id long, text string, id long, data string")
    assert result(remove_repeats(df, shard=shard, memory=1 << 12)) == brute_repeats(crowd, 200)


@pytest.mark.parametrize("shard", [6_000, 4, 1])
def test_tasks_follow_the_bytes_to_sort(spark, crowd, monkeypatch, shard):
    """As many tasks as the bytes give, whatever adaptive execution would merge, with the same rows."""
    inner, seen = suffix_dedup._sort_shards, []

    def spy(parts, *given):
        out = inner(parts, *given)
        seen.append((parts.selectExpr("sum(length(data) + 1)").first()[0], plan_of(out)))
        return out

    monkeypatch.setattr(suffix_dedup, "_sort_shards", spy)
    df = spark.createDataFrame(crowd, "doc_id long, text string")
    assert result(remove_repeats(df, shard=shard, share=1_000)) == brute_repeats(crowd, 200)
    n_bytes, plan = seen[0]
    tasks = int(re.search(r"hashpartitioning\(shard#\d+L, (\d+)\), REPARTITION_BY_NUM", plan)[1])
    assert n_bytes > 20_000 and n_bytes / 1_000 <= tasks <= 4 * n_bytes / 1_000


@pytest.mark.parametrize("text", [b"ba", b"bab", b"bb", b"b", b"baab"])
def test_texts_of_few_turns(text):
    order, prefixes = suffix_order(np.frombuffer(text, dtype=np.uint8), 5)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_query_equals_brute_force(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    assert result(queries.op4_suffix_dedup(spark, SF)) == brute_repeats(rows, 200)


def test_no_rows_and_kept_bytes(spark):
    df = spark.createDataFrame([(1, "é" * 300 + "tail"), (2, "other")], "doc_id long, text string")
    got = {r.doc_id: r for r in remove_repeats(df).collect()}
    assert got[1].kept == b"tail" and got[1].n_removed == 600 and got[2].kept is None
    assert remove_repeats(df.limit(0)).count() == 0
