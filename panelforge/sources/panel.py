"""Reading and writing panels."""

from __future__ import annotations

import datetime as dtm
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F


def load_panel(
    spark: SparkSession,
    path: str,
    start: dtm.date,
    end: dtm.date,
    columns: list[str] | None = None,
    in_universe: bool = True,
    names: dict[str, str] | None = None,
    date: str = "dt",
    universe: str = "in_universe",
) -> DataFrame:
    """Rows of a Parquet panel between two dates (inclusive), optionally only the assets in the universe.

    ``names`` maps file column names to the library's (``asset``, ``dt``, ``ret``). Date range, universe flag and
    column list all reach the Parquet scan. A timestamp date column is cast to a date after the filter on it.
    """
    df = spark.read.parquet(path)
    df = df.withColumnsRenamed(names or {})
    if dict(df.dtypes)[date] == "date":
        df = df.where(F.col(date).between(F.lit(start), F.lit(end)))
    else:
        after = end + dtm.timedelta(days=1)
        raw = F.col(date)
        df = df.where((raw >= F.lit(start).cast("timestamp_ntz")) & (raw < F.lit(after).cast("timestamp_ntz")))
        df = df.withColumn(date, raw.cast("date"))
    if in_universe:
        require_columns(df, universe)
        df = df.where(F.col(universe))
    return df.select(*columns) if columns else df


def read_table(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One Parquet table, a ``*`` pattern, or several paths read as one table. A missing path raises.

    Of a table that ``replace_table`` wrote, the version that is current now.
    """
    if not isinstance(path, str):
        return spark.read.parquet(*path)
    return spark.read.parquet(path if "*" in path else current_version(spark, path) or path)


def read_year_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files named ``YYYY.parquet`` of a folder and the ``year=YYYY`` folders of ``write_by_year``, as one table."""
    year = "[0-9][0-9][0-9][0-9]"
    return spark.read.parquet(f"{folder.rstrip('/')}/{{{year}.parquet,year={year}}}")


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


_POINTER = "_current"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder that the pointer of ``path`` names, or None if ``path`` has no pointer."""
    pointer, files = _files(spark, f"{path.rstrip('/')}/{_POINTER}")
    if not files.exists(pointer):
        return None
    stream = files.open(pointer)
    try:
        return f"{path.rstrip('/')}/{bytes(stream.readAllBytes()).decode()}"
    finally:
        stream.close()


def replace_table(df: DataFrame, path: str, accept: Callable[[], None] | None = None) -> None:
    """Write ``df`` as a new version of the table at ``path``; readers see the old version or the new one, never none.

    The version is written to a folder of its own, ``accept`` may then raise to refuse it, and a one-file pointer is
    renamed over the old one. A write that fails leaves the table as it was, and ``df`` may read the table it replaces.
    The version before stays for readers that have begun; older ones are deleted. Plain files that ``path`` holds from
    before its first version are left alone and no longer read.
    """
    spark, root = df.sparkSession, path.rstrip("/")
    before = current_version(spark, root)
    name = f"v-{uuid.uuid4().hex}"
    version, files = _files(spark, f"{root}/{name}")
    try:
        df.write.parquet(f"{root}/{name}")
        if accept:
            accept()
    except BaseException:
        files.delete(version, True)
        raise
    fresh, pointer = (_files(spark, f"{root}/{n}")[0] for n in (f"{_POINTER}-{name}", _POINTER))
    stream = files.create(fresh, True)
    try:
        stream.write(name.encode())
    finally:
        stream.close()
    fs = spark._jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    over[0] = getattr(fs, "Options$Rename").OVERWRITE
    at = files.makeQualified(version)
    fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(
        files.makeQualified(fresh), files.makeQualified(pointer), over)
    kept = {name, before and before.rsplit("/", 1)[1]}
    for status in files.listStatus(version.getParent()):
        if status.isDirectory() and status.getPath().getName().startswith("v-") and status.getPath().getName() not in kept:
            files.delete(status.getPath(), True)


def store_by_series(df: DataFrame, name: str, path: str, buckets: int, key: str = "asset", order: str = "dt") -> DataFrame:
    """Write a panel as the catalogue table ``name`` at ``path``, dealt to ``buckets`` by ``key`` and sorted, and read it back.

    Windows over a series then need no exchange, nor do joins of panels stored alike on ``key`` and ``order`` if
    ``spark.sql.requireAllClusterKeysForCoPartition`` is false. A series lies in one file, so choose ``buckets`` by the rows (``series_parts``), so that a bucket
    fits a task. An existing table of the name raises.
    """
    rows = df.repartition(buckets, key)  # one file per bucket
    rows.write.bucketBy(buckets, key).sortBy(key, order).option("path", path).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def write_by_year(df: DataFrame, path: str, date: str = "dt") -> None:
    """Write one ``year=`` folder per calendar year; a large year is spread over several even files.

    Only the years in ``df`` are replaced.
    """
    by_year = df.withColumn("year", F.year(date)).hint("rebalance", "year")
    by_year.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def require_rows(df: DataFrame, what: str = "input") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def require_unique_key(df: DataFrame, *key: str) -> DataFrame:
    """Raise if two rows share a key. One aggregation with map-side combine."""
    twice = df.groupBy(*key).count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError(f"{key} is not unique")
    return df


def with_contract(df: DataFrame, key: str, order: str, required: list[str] | tuple[str, ...] = ()) -> tuple[DataFrame, Observation]:
    """``df`` and counts taken while it is computed: rows, repeated (rows like the one before them in key and order), and
    ``null_<column>`` for the key, the order and each of ``required``.

    Repeats are seen by a lag over the series, so a plan with windows over the series needs no further exchange or scan.
    The counts are there once a job has computed all rows.
    """
    seen = Observation()
    twice = F.lag(order).over(Window.partitionBy(key).orderBy(order)) == F.col(order)
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in dict.fromkeys((key, order, *required))]
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if("__twice").alias("repeated"), *nulls]
    return df.withColumn("__twice", twice).observe(seen, *counts).drop("__twice"), seen


def check_contract(counts: dict[str, int], what: str = "input", nulls: tuple[str, ...] = ()) -> None:
    """Raise if there are no rows, repeated keys, or nulls in the columns ``nulls``."""
    if not counts["rows"]:
        raise ValueError(f"{what} is empty")
    if counts["repeated"]:
        raise ValueError(f"{what} is not unique: {counts['repeated']} rows repeat asset and date")
    missing = {c: n for c in nulls if (n := counts[f"null_{c}"])}
    if missing:
        raise ValueError(f"{what} has nulls: {missing}")
