"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where none is set and all runs on one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named


#: The folder of ``passing`` tables, in the thread that makes them.
_PASSING: ContextVar[str | None] = ContextVar("passing", default=None)
#: Drops a query's shuffle files when it ends, and not only when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, codec: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, so that what is used twice is computed once."""
    path = f"{_PASSING.get() or shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are ``stored`` meanwhile go at the end; what is to last must be written by then."""
    folder = f"{shared_dir(spark)}/passing-{uuid.uuid4().hex}"
    token = _PASSING.set(folder)
    try:
        yield
    finally:
        _PASSING.reset(token)
        remove(spark, folder)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run meanwhile, those of streams that start meanwhile too, leave no shuffle files."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def broadcast_if_small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """``df``, a stored table, with a broadcast hint if it has few rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= most_rows else df


def remove(spark: SparkSession, *folders: str) -> None:
    """Removes folders that nothing reads any more; what isn't there is passed over."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
