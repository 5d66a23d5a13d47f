"""Intermediate tables in the shared folder of the cluster.

A staged table is computed once, survives the loss of executors, and is re-read with column pruning, so several
passes over it (per-date statistics, then the rows themselves) cost narrow scans instead of a repeated shuffle.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

_SETTING = "spark.checkpoint.dir"


def _on_one_machine(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def staging_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where none is named, a temporary folder is set, but only for a local master: the machines of a cluster would each
    write to their own disk.
    """
    context = spark.sparkContext
    root = spark.conf.get(_SETTING, None) or context.getConf().get(_SETTING) or context.getCheckpointDir()
    if not root:
        if not _on_one_machine(spark):
            raise ValueError(f"set {_SETTING} to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="run-")
        context.setCheckpointDir(root)
    return root


_scope: ContextVar[list[str] | None] = ContextVar("staging_scope", default=None)


@contextmanager
def staging_scope(spark: SparkSession) -> Iterator[None]:
    """Tables staged and scratch folders asked for inside the block are deleted at its end; write the results that read
    them before.

    Scopes nest and don't see each other's tables. Tables staged outside any scope stay until their folder is cleared.
    """
    mine: list[str] = []
    token = _scope.set(mine)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in mine:
            _delete(spark, path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes with the scope it was asked for in."""
    path = f"{staging_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    mine = _scope.get()
    if mine is not None:
        mine.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def checked(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """Reader of a staged folder. Raises if it doesn't hold as many rows as were written."""
    table = spark.read.parquet(path)
    found = table.count()
    if found != rows:
        raise RuntimeError(f"{path} holds {found} of {rows} written rows; is the folder shared by all machines?")
    return table


def staged(df: DataFrame, name: str = "panel") -> DataFrame:
    """Write ``df`` to a fresh Parquet folder and return a reader of it. Runs the plan of ``df`` once.

    Select what is read later first: every column of ``df`` is written.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return checked(spark, path, seen.get["rows"])
