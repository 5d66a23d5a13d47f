"""Small expressions and helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

SPACES = " \t\n\x0b\f\r"
"""The white space of the contracts: 20 and 09 to 0D."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once, however often the body names it, inside lambdas too."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case; all other letters stay."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def text_of(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def digest_pair(c: Column) -> list[Column]:
    """128 bits of hash as two longs; the second hash starts from another seed."""
    return [F.xxhash64(c).alias("h1"), F.xxhash64(F.lit("second"), c).alias("h2")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Keeps the session's Arrow batches at ``BATCH_ROWS`` rows and 32 MB, so that long texts fit a Python worker."""
    if int(spark.conf.get(ROWS, "10000")) in (0, 10000):
        spark.conf.set(ROWS, str(BATCH_ROWS))
    spark.conf.set(BYTES, str(32 << 20))


def arrow_type(ddl: str) -> pa.DataType:
    return to_arrow_type(_parse_datatype_string(ddl))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], ddl: str) -> DataFrame:
    """``mapInArrow`` with a function made once per task; it turns a batch into columns by name."""
    small_batches(df.sparkSession)
    kind = arrow_type(ddl)

    def run(batches):
        body = make()
        for batch in batches:
            if batch.num_rows:
                columns = body(batch)
                yield pa.RecordBatch.from_arrays([as_array(columns[f.name], f.type) for f in kind], [f.name for f in kind])

    return df.mapInArrow(run, ddl)


def as_array(values, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, type=kind)


def per_text(text: Column, make: Callable[[], Callable[[list[str]], dict]], ddl: str, spark: SparkSession) -> Column:
    """A struct for each text. The other columns of the row stay in the JVM; ``make`` runs once per task."""
    small_batches(spark)
    kind = arrow_type(ddl)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        body = make()
        for column in columns:
            found = body([x or "" for x in column.to_pylist()])
            yield pa.StructArray.from_arrays([as_array(found[f.name], f.type) for f in kind], [f.name for f in kind])

    return F.arrow_udf(run, ddl)(text)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (the finaliser of splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACES = 64
_LETTER = mixed(np.arange(1, _PLACES * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
"""A random 64-bit value for each byte at each place in a word; beyond that many places it is mixed once more."""
_INSIDE = ~np.isin(np.arange(256), list(SPACES.encode()))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of each word of ``data``, words being parted by ASCII white space: sums of their bytes' values."""
    letters = np.frombuffer(data, dtype=np.uint8)
    inside = _INSIDE[letters]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    if not len(edges):
        return np.zeros(0, dtype=np.uint64)
    size = edges[1::2] - edges[::2]
    first = np.cumsum(size) - size
    letters = letters[inside]
    place = np.arange(len(letters)) - np.repeat(first, size)
    value = _LETTER[(place & (_PLACES - 1)) << 8 | letters]
    far = np.flatnonzero(place >= _PLACES)
    if len(far):
        value[far] = mixed(value[far] + (place[far] // _PLACES).astype(np.uint64))
    return mixed(np.add.reduceat(value, first) + size.astype(np.uint64))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words; with fewer words, one for the whole sequence; none without words."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[i:i + n]
    return mixed(out)
