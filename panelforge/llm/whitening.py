"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import small_batches
from .vectors import integers, matrix, usual_length

SCALE, OFFSET, LARGEST = 64, 1_000_000, 1 << 31
_LONG = (1 << 63) - 1


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with ``a[order][:, order] = L L'``; L has a column for each pivot above rounding, the largest first."""
    a, n = a.copy(), len(a)
    order, factor = np.arange(n), np.zeros((n, n))
    least = n * np.finfo(np.float64).eps * max(a.diagonal().max(initial=0.0), 0.0)
    for k in range(n):
        p = k + int(np.argmax(a.diagonal()[k:]))
        if a[p, p] <= least:
            return factor[:, :k], order
        for m in (a, factor):
            m[[k, p]] = m[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        factor[k, k] = np.sqrt(a[k, k])
        factor[k + 1:, k] = a[k + 1:, k] / factor[k, k]
        a[k + 1:, k + 1:] -= np.outer(factor[k + 1:, k], factor[k + 1:, k])
    return factor, order


def orthogonal_columns(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns of ``factor`` rotated in pairs until all are orthogonal to rounding, by falling norm."""
    columns = np.ascontiguousarray(factor.T)
    r, eps = len(columns), np.finfo(np.float64).eps
    for _ in range(sweeps):
        turned = False
        for i in range(r - 1):
            for j in range(i + 1, r):
                a, b = columns[i], columns[j]
                aa, bb, ab = a @ a, b @ b, a @ b
                if abs(ab) <= eps * np.sqrt(aa * bb):
                    continue
                turned = True
                z = (bb - aa) / (2 * ab)
                t = (1.0 if z >= 0 else -1.0) / (abs(z) + np.hypot(1.0, z))
                c = 1 / np.hypot(1.0, t)
                columns[i], columns[j] = c * a - c * t * b, c * t * a + c * b
        if not turned:
            break
    return columns[np.argsort(-np.einsum("ij,ij->i", columns, columns), kind="stable")].T


def eigen(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a positive semidefinite matrix, falling, and unit eigenvectors as columns; none below rounding."""
    factor, order = pivoted_cholesky(scatter)
    turned = orthogonal_columns(factor)
    size = np.sqrt(np.einsum("ij,ij->j", turned, turned))
    vectors = np.empty_like(turned)
    vectors[order] = turned / size
    return size ** 2, vectors


@dataclass(frozen=True)
class Whitening:
    """Fitted on ``n`` vectors with sums ``total``: eigenvalues, components as columns, and the trace, of the covariance."""

    n: int
    total: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.total) @ (self.components / np.sqrt(self.values))


def spread(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """n * x - S, exact: in longs where they suffice, else in Python's integers."""
    reach = n * int(np.abs(x).max(initial=0)) + max((abs(int(s)) for s in total), default=0)
    kind = np.int64 if reach <= _LONG else object
    return x.astype(kind) * n - np.array([int(s) for s in total], dtype=kind)


def centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """x - S / n with one rounding."""
    return (spread(x, n, total) / n).astype(np.float64)


def deviations(x: np.ndarray, n: int, total: np.ndarray) -> list[int | None]:
    """The sum of (n * x - S)^2 of each row, exact; None where a long can't hold it."""
    far = spread(x, n, total)
    reach = max(abs(int(far.max(initial=0))), abs(int(far.min(initial=0))))
    if reach * reach * max(x.shape[1], 1) > _LONG:
        far = far.astype(object)
    return [v if v <= _LONG else None for v in (far * far).sum(axis=1).tolist()]


def _summed(rows: DataFrame, size: int, part: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum of a small matrix over all vectors: one matrix per task, added up by place on the cluster."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            if batch.num_rows:
                one = part(matrix(batch, size))
                found = one if found is None else found + one
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array(found.tolist())], ["i", "row"])

    cells = rows.select("x").mapInArrow(run, f"i int, row array<{kind}>").select("i", F.posexplode("row").alias("j", "v"))
    cells = cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    shape = max((r.i for r in cells), default=-1) + 1, max((r.j for r in cells), default=-1) + 1
    out = np.zeros(shape, dtype=np.int64 if kind == "bigint" else np.float64)
    for r in cells:
        out[r.i, r.j] = r.v
    return out


def fit_whitening(rows: DataFrame, size: int, keep: int) -> Whitening | None:
    """Counts and sums first, then the scatter of centred vectors; None without vectors.

    The driver gets ``size`` sums and ``size`` squared entries of the scatter, whatever the number of rows.
    """
    first = _summed(rows, size, lambda x: np.vstack([x.sum(axis=0), np.full(size, len(x))]), "bigint")
    if not size or not len(first):
        return None
    n, total = int(first[1, 0]), first[0]

    def products(x: np.ndarray) -> np.ndarray:
        c = centred(x, n, total)
        return c.T @ c

    covariance = _summed(rows, size, products, "double") / n
    values, components = eigen((covariance + covariance.T) / 2)
    return Whitening(n, total, values[:keep], components[:, :keep], float(covariance.trace()))


OUTPUT = ("component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: int = 32) -> DataFrame:
    """Per vector and component (1 to ``keep``, or the dimension): id, component, n, deviation, whitened, explained, identity_error.

    Entries c become the long x = floor(64 c) + 1000000. Components are eigenvectors of x's covariance over all vectors,
    by falling eigenvalue. ``identity_error`` is measured on all whitened vectors, in a pass of its own.

    A null vector, or one with a null or non-finite entry, is left out; so are vectors whose length isn't the most
    frequent one and those with an entry beyond 2^31 after scaling. Repeated rows and ids each count, null ids too.
    Where vectors span fewer dimensions, further components have null ``whitened`` and 0 explained (null if all
    vectors are equal), and the error is taken over the others. A deviation beyond a long is null. No rows: no rows.

    Five narrow scans; between them only sums of the dimension's size or its square are shuffled. A task holds one
    batch and one such matrix.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    size = usual_length(vectors, vector_col)
    rows = integers(vectors.select(F.col(id_col).alias("__id"), F.col(vector_col).alias("__v")), "__v", size, SCALE, LARGEST)
    rows = rows.select("__id", F.transform("x", lambda x: x + OFFSET).alias("x"))
    fitted = fit_whitening(rows, size, keep)
    id_type = vectors.schema[id_col].dataType.simpleString()
    if fitted is None:
        return spark.createDataFrame([], f"{id_col} {id_type}, {OUTPUT}")
    rank, shown = len(fitted.values), min(keep, size)

    def squares(x: np.ndarray) -> np.ndarray:
        z = fitted.apply(x)
        return z.T @ z

    error = float(np.abs(_summed(rows, size, squares, "double") / fitted.n - np.eye(rank)).max()) if rank else 0.0
    explained = [float(v) / fitted.trace for v in fitted.values] + [0.0 if rank else None] * (shown - rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            x = matrix(batch, size)
            z = np.full((rows, shown), np.nan)
            z[:, :rank] = fitted.apply(x)
            flat, times = z.ravel(), np.repeat(np.arange(rows), shown)
            columns = [
                batch.column("__id").take(pa.array(times)), pa.array(np.tile(np.arange(1, shown + 1, dtype=np.int32), rows)),
                pa.array(np.full(len(flat), fitted.n, dtype=np.int64)),
                pa.array(deviations(x, fitted.n, fitted.total), pa.int64()).take(pa.array(times)),
                pa.array(flat, mask=np.tile(np.arange(shown) >= rank, rows)), pa.array(explained * rows, pa.float64()),
                pa.array(np.full(len(flat), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [id_col, *[c.split()[0] for c in OUTPUT.split(", ")]])

    return rows.mapInArrow(run, f"{id_col} {id_type}, {OUTPUT}")
