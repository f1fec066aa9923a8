"""Scratch tables in the shared folder: they cut lineage, and outlive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Parquet settings under which a column of up to 2 million different numbers is written by its dictionary; pages are
#: large because the first one decides.
COMPACT = {"parquet.dictionary.page.size": str(16 << 20), "parquet.page.row.count.limit": "1000000"}

_written: list[tuple[SparkSession, str]] = []
_own: ContextVar[list[str] | None] = ContextVar("_own", default=None)


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="graphloom-")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where that is unset, a temporary
    folder in local mode and the warehouse on a cluster, never a machine's own folder."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return f"file://{_local_root()}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_graphloom"


def scratch_path(spark: SparkSession) -> str:
    """A new path that is removed when the driver ends."""
    path = f"{scratch_root(spark)}/graphloom-{uuid.uuid4().hex}"
    _written.append((spark, path))
    if (own := _own.get()) is not None:
        own.append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost
    executor costs no recomputation."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def set_conf(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize_compact(*parts: DataFrame) -> DataFrame:
    """materialize() for large tables of few different values: one table of all parts, written one after the other. The
    shuffle files of a part go when it is written, and columns keep their dictionaries."""
    spark = parts[0].sparkSession
    path = scratch_path(spark)
    with set_conf(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        for part in parts:
            part.write.options(**COMPACT).mode("append").parquet(path)
    return spark.read.schema(parts[0].schema).parquet(path)


@contextmanager
def own_tables(spark: SparkSession, cleanup: bool = True) -> Iterator[None]:
    """Scratch tables that are made inside, by this thread, are removed at the end."""
    token = _own.set([])
    try:
        yield
    finally:
        paths = _own.get()
        _own.reset(token)
        for path in paths if cleanup else []:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Remove a table of materialize() that nothing reads any more, ahead of the driver's end."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM is gone: the cluster's own cleaning of the folder is left
            return
