"""Integer vectors made of embeddings, and Arrow batches of them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def _whole(vector: Column, most: float) -> Column:
    """Not null, and every entry is a number of at most ``most``; NaN and infinity are larger than that."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) <= F.lit(float(most))))


def usual_length(df: DataFrame, vector: str) -> int:
    """The most frequent length of the vectors without null and non-finite entries, the longest of equally frequent; 0 without any."""
    sizes = df.where(_whole(F.col(vector), np.finfo(np.float64).max)).groupBy(F.size(vector).alias("d")).count()
    found = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def integers(df: DataFrame, vector: str, size: int, scale: int, most: int) -> DataFrame:
    """Rows whose ``vector`` has ``size`` entries, all finite, with it as ``x``: floor(scale * entry) as long.

    Rows with an entry beyond ``most`` after scaling are left out, too: their products would not fit a long.
    """
    rows = df.where(_whole(F.col(vector), most / scale) & (F.size(vector) == size))
    return rows.withColumn("x", F.transform(vector, lambda c: F.floor(c.cast("double") * float(scale)).cast("long")))


def matrix(batch: pa.RecordBatch, size: int, name: str = "x") -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
