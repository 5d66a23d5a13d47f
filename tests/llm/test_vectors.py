"""Whitening against NumPy's eigenvectors, hard negatives against all pairs, curve and bounds."""

import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import hard_negatives as hn, queries, whitening as wh
from panelforge.llm.hilbert import hilbert_keys

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


def embeddings(where=SF):
    return duckdb.connect().execute(f"select vec_id, embedding, label from '{where}/embeddings.parquet' order by 1").fetchall()


@pytest.mark.parametrize("d, bits", [(2, 1), (2, 4), (3, 2), (4, 2), (3, 3)])
def test_neighbours_on_the_curve_touch(d, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=d)))
    keys = hilbert_keys(points, bits)
    order = sorted(range(len(points)), key=keys.__getitem__)
    assert len(set(keys)) == len(points) and (np.abs(np.diff(points[order], axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_are_reached():
    rng = np.random.default_rng(0)
    a, x = rng.integers(-9, 9, (20, 4)), rng.integers(-9, 9, (50, 4))
    low, high = x.min(axis=0)[None], x.max(axis=0)[None]
    least, most = hn.score_bounds(a, low, high)
    s = a @ x.T
    assert (s >= least).all() and (s <= most).all()
    corners = np.array(list(itertools.product(*zip(low[0], high[0]))))
    assert ((a @ corners.T).max(axis=1) == most[:, 0]).all() and ((a @ corners.T).min(axis=1) == least[:, 0]).all()
    big = np.array([[1 << 30, -(1 << 30)]])
    assert hn.products(big, big)[0, 0] == 1 << 61


def negatives(rows, positives=5, negatives=3):
    """All pairs, straight from the contract."""
    rows = [(i, np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64), (l + 1) % 10 if i % 7 == 0 else l) for i, v, l in rows
            if i is not None and v is not None and l is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for i, a, own in rows:
        if i % 50:
            continue
        scored = sorted((-int(a @ x), j, l) for j, x, l in rows if j != i)
        for s, j, _ in [r for r in scored if r[2] == own][:positives]:
            fits = [(t, k) for t, k, l in scored if l != own and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(fits)]
    return sorted(out)


def as_rows(df):
    return sorted(map(tuple, df.collect()))


def test_hard_negatives_query(spark):
    assert as_rows(queries.op12_hard_negatives(spark, SF)) == negatives(embeddings())


def test_small_blocks_ties_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(0, 4, 3) / 2.0).tolist(), int(i % 3)) for i in range(400)]
    rows += [(1000, None, 1), (1050, [1.0, None, 1.0], 1), (1100, [1.0, NAN, 1.0], 1), (1150, [INF, 0.0, 0.0], 2), (1200, [1.0], 2),
             (1250, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1), (1300, [1e300, 0.0, 0.0], 1), (1350, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"x": F.lit(1), "block": F.lit(2)})
    want = negatives([r for r in rows if r[1] is None or len(r[1]) == 3 and 1e300 not in r[1]])
    assert as_rows(hn.hard_negatives(df.repartition(3), block_rows=7)) == want and len(want) > 50


def test_negative_and_zero_scores_and_few_rows(spark):
    rows = [(0, [-1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [0.0, -1.0], 2), (50, [2.0, 2.0], 2), (51, [1.0, 1.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert as_rows(hn.hard_negatives(df)) == negatives(rows)
    assert hn.hard_negatives(df.where("label > 9")).collect() == [] and hn.hard_negatives(df.where("vec_id = 51")).collect() == []


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(50, [1.0, 0.0], 1)] * 2 + [(1, [1.0, 0.0], 1), (2, [0.9, 0.0], 2), (2, [0.8, 0.0], 2)]
    found = as_rows(hn.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")))
    assert found == sorted([(50, 1, 1, 2, 65536, 58880), (50, 1, 2, 2, 65536, 52224)] * 2)


def test_clusters_leave_blocks_unread(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 8)) * 4
    rows = [(i, (centres[i % 40] + rng.normal(size=8) * 0.02).tolist(), i % 40 % 10) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    x = hn.integers(df, "embedding", 8, hn.SCALE, 1 << 30).select("vec_id", "label", "x")
    blocks = hn.blocks_of(x, 8, (-4000, 4000), 50, 5, 25)
    chunks = hn.anchor_chunks(blocks, 8, 16)
    needed = hn.needed_blocks(chunks, blocks, 8, 4, True)
    read = sum(len(r.who) // 4 for r in needed.collect())
    assert chunks.count() == 3 and read < 0.1 * 40 * blocks.count()
    assert as_rows(hn.hard_negatives(df, block_rows=25)) == negatives([(i, v, l) for i, v, l in rows])


def whitened(rows):
    x = np.array([np.floor(64 * np.array(v, dtype=np.float64)) for _, v in rows]).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    c = (n * x - total) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    return n, ((n * x - total) ** 2).sum(axis=1), e[::-1], q[:, ::-1], c


def test_whitening_query(spark):
    rows = [(i, v) for i, v, _ in embeddings()]
    n, deviation, e, q, c = whitened(rows)
    found = queries.op13_whitening(spark, SF).orderBy("vec_id", "component").toPandas()
    assert list(found.component) == list(range(1, 33)) * n and set(found.n) == {n} and found.identity_error.nunique() == 1
    assert found.identity_error[0] < 1e-10
    assert (found.deviation.to_numpy().reshape(n, 32) == deviation[:, None]).all()
    assert np.allclose(found.explained[:32], e[:32] / e.sum(), rtol=1e-12)
    z, want = found.whitened.to_numpy().reshape(n, 32), c @ q[:, :32] / np.sqrt(e[:32])
    sign = np.sign((z * want).sum(axis=0))
    assert np.abs(z - want * sign).max() < 1e-8


@pytest.mark.parametrize("seed", range(3))
def test_factor_and_rotations(seed):
    rng = np.random.default_rng(seed)
    b = rng.normal(size=(9, 6)) * np.logspace(0, -4, 6)
    a = b @ b.T  # rank 6 of 9
    factor, order = wh.pivoted_cholesky(a)
    assert factor.shape == (9, 6) and np.allclose(factor @ factor.T, a[order][:, order], atol=1e-14)
    assert np.allclose(np.triu(factor, 1), 0) and (np.diff(np.diag(factor)) <= 0).all()
    values, vectors = wh.eigen(a)
    assert np.allclose(values, np.linalg.svd(b, compute_uv=False) ** 2, rtol=1e-10)
    assert np.allclose(vectors.T @ vectors, np.eye(6), atol=1e-12) and np.allclose(vectors * values @ vectors.T, a, atol=1e-14)


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(7)
    good = [(i, [float(a), float(b), float(a + b), 5.0]) for i, (a, b) in enumerate(rng.integers(-9, 9, (60, 2)))] + [(None, [1.0, 2.0, 3.0, 5.0]), (3, [0.0, 0.0, 0.0, 5.0])]
    bad = [(100, None), (101, [1.0, None, 1.0, 5.0]), (102, [NAN, 0.0, 0.0, 5.0]), (103, [0.0, -INF, 0.0, 5.0]), (104, [1.0]), (105, []), (106, [1e30, 0.0, 0.0, 5.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").withColumns({"n": F.lit(1), "x": F.lit("y")})
    found = wh.whiten(df.repartition(3)).toPandas()
    n, deviation, e, q, c = whitened(good)
    assert len(found) == 4 * n and set(found.n) == {n} and sorted(found.deviation) == sorted(np.repeat(deviation, 4))
    assert found[found.component > 2].whitened.isna().all() and (found[found.component > 2].explained == 0).all()
    assert found[found.component <= 2].whitened.notna().all() and found.identity_error[0] < 1e-12
    assert np.allclose(found[found.component == 1].explained, e[0] / e.sum())


def test_whitening_of_equal_rows_and_none(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id int, embedding array<float>")
    found = wh.whiten(df).collect()
    assert len(found) == 4 and all(r.whitened is None and r.explained is None and r.deviation == 0 for r in found)
    none = wh.whiten(df.where("vec_id > 9"))
    assert none.collect() == [] and none.columns == wh.whiten(df).columns


def test_exact_sums_beyond_longs():
    x = np.array([[1 << 32, 0], [0, 0]], dtype=np.int64)
    assert wh.deviations(x, 2, x.sum(axis=0)) == [None, None]
    assert wh.deviations(x // 4, 2, (x // 4).sum(axis=0)) == [1 << 60, 1 << 60]
    assert wh.centred(np.array([[1 << 60]], dtype=np.int64), 100, np.array([100 << 60], dtype=object)).tolist() == [[0.0]]
