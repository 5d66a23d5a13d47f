"""Near duplicates against all pairs, and components against union-find."""

import random

import duckdb
import numpy as np
import pytest

import brute
from panelforge.llm import near_dedup, queries
from panelforge.llm.components import components
from panelforge.llm.near_dedup import near_duplicates
from panelforge.llm.text import word_hashes

SF = "/root/testdata/sf0.01"


def shingle_set(text, size):
    w = brute.words(brute.low(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def find(group, i):
    while group[i] != i:
        i = group[i]
    return i


def all_pairs(rows, size, percent):
    sets = {i: shingle_set(t, size) for i, t in rows}
    group = {i: i for i in sets}
    ids = sorted(sets)
    holders = {}
    for i in ids:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    for i in ids:
        common = {}
        for s in sets[i]:
            for j in holders[s]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                a, b = find(group, i), find(group, j)
                group[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(group, i)) for i in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n long, kept string")


def test_query_equals_all_pairs(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    got = queries.op3_near_dedup(spark, SF)
    assert result(got) == all_pairs(rows, 3, 85)


@pytest.fixture(scope="module")
def crowd():
    """One large group of copies with a few changed words each, exact copies, a chain, and unrelated texts."""
    rng = random.Random(11)
    base = [f"w{rng.randint(0, 400)}" for _ in range(150)]
    rows = []
    for i in range(700):
        words = list(base)
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(150)] = f"x{rng.randint(0, 99999)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base)) for i in range(50)]
    rows += [(2000 + i, " ".join(f"u{rng.randint(0, 300)}" for _ in range(60))) for i in range(200)]
    chain = [f"c{i}" for i in range(200)]
    rows += [(3000 + i, " ".join(chain[4 * i:4 * i + 100])) for i in range(20)]
    return rows


@pytest.mark.parametrize("limits", [{}, {"node_rows": 100, "leaf": 32}])
def test_large_groups(spark, crowd, limits):
    got = result(near_duplicates(frame(spark, crowd), size=3, threshold=0.85, **limits))
    want = all_pairs(crowd, 3, 85)
    assert {i: n for i, (n, _) in got.items()} == {i: n for i, (n, _) in want.items()}
    wrong = [i for i in want if got[i] != want[i]]
    assert not wrong if not limits else len(wrong) <= 3, wrong


def edited(rng, words, n, mark):
    """A copy of ``words`` with ``n`` of them replaced by words of its own."""
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"{mark}{k}x{rng.randint(0, 10**9)}"
    return words


def test_copies_linked_through_one_original_alone(spark):
    """Far too many for a leaf, none linked to another, in nodes without a token left."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(402)]
    rows = [(i, " ".join(edited(rng, base, 10, f"e{i}_"))) for i in range(1, 500)]
    rows[300] = (301, " ".join(base))
    want = all_pairs(rows, 3, 85)
    assert {c for _, c in want.values()} == {1}
    assert result(near_duplicates(frame(spark, rows), size=3, threshold=0.85, leaf=32)) == want


def test_pairs_in_one_large_node(spark):
    """Pairs that only link to each other, in nodes without a token left that are too large for a task."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(402)]
    rows = []
    for i in range(200):
        one = edited(rng, base, 10, f"e{i}_")
        rows += [(i, " ".join(one)), (1000 + i, " ".join(edited(rng, one, 3, f"f{i}_")))]
    want = all_pairs(rows, 3, 85)
    assert all(c == i % 1000 for i, (_, c) in want.items())
    assert result(near_duplicates(frame(spark, rows), size=3, threshold=0.85, node_rows=40, leaf=16)) == want


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "two words"), (5, "TWO  words"), (6, "one"), (7, "é one"), (8, "É one"), (None, "one"),
            (9, "a b c d"), (9, "q r s t u"), (10, "a b c d"), (11, "long " * 50_000)]
    out = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_duplicates(frame(spark, rows), size=3, threshold=0.85).collect())
    assert out == [(0, 1, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True),
                   (7, 1, 7, True), (8, 1, 8, True), (9, 2, 9, True), (9, 3, 9, True), (10, 2, 9, False), (11, 1, 11, True)]
    assert near_duplicates(frame(spark, [])).count() == 0


def test_rows_of_one_id_with_different_texts(spark):
    rows = [(8, "a b c d"), (9, "a b c d"), (9, "q r s t u"), (9, None), (20, "q r s t u"), (21, "k l m n")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(frame(spark, rows), size=3, threshold=0.85).collect())
    assert got == [(8, 8, True), (9, 8, False), (9, 8, False), (9, 8, False), (20, 8, False), (21, 21, True)]


def test_sketch_estimates_similarity():
    rng = random.Random(2)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(2000)]
    other = words[:1700] + [f"v{i}" for i in range(300)]
    a, b = (near_dedup.shingles(" ".join(x), 3) for x in (words, other))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    x, y = near_dedup.minima(a), near_dedup.minima(b)
    assert abs((x == y).mean() - true) < 0.12 and abs(1 - 2 * ((x ^ y) & np.uint64(1)).mean() - true) < 0.18


@pytest.mark.parametrize("threshold", [0.7, 0.8, 0.85, 0.95])
def test_few_pairs_at_the_threshold_are_missed(threshold):
    """By the model of the trees, and among sketches of pairs drawn at the threshold."""
    assert near_dedup.missed(threshold, near_dedup.second_children(threshold)) <= 1e-4
    rng = np.random.default_rng(3)
    differ = rng.binomial(near_dedup.BITS, (1 - threshold) / 2, 400_000)
    assert (differ > near_dedup.widest(threshold)).mean() <= 1.5e-4
    assert near_dedup.second_children(0.8) > 4 and near_dedup.second_children(0.95) < near_dedup.second_children(0.8)


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(500, 500 + i) for i in range(1, 40)] + [(7, 7)]
    links += [(rng.randint(1000, 1200), rng.randint(1000, 1200)) for _ in range(120)]
    group = {x: x for l in links for x in l}
    for a, b in links:
        a, b = find(group, a), find(group, b)
        group[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(group, x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes_depend_on_the_words_alone():
    words = ["a", "ab", "ba", "x" * 64, "x" * 65, "x" * 128, "x" * 129, "y" + "x" * 128, "x" * 64 + "y" + "x" * 64, "é", "a\x1c"]
    one = word_hashes(" ".join(words).encode())
    assert len(set(one.tolist())) == len(words)
    assert (word_hashes(("\n " + "\t\x0b ".join(words) + "\r\x0c").encode()) == one).all()
    assert len(word_hashes(b"")) == len(word_hashes(b" \n")) == 0
