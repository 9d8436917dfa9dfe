"""A changelog stored by time, so that reading what changed costs what changed.

Each batch is written as files that follow one another in time, and a manifest keeps the
first and last time of every file.  A reader opens only files that reach past its watermark.
Deliveries keep their watermark with their output: what was delivered and how far is one
commit, so a stop between the two loses and repeats nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def written(spark: SparkSession, path: str) -> DataFrame | None:
    """The batches under ``path``, with their numbers as column ``batch``; none yet before the first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        # a folder may be there before its first batch is
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


class ChangeLog:
    """Rows with ``updated_at`` in ``folder``, added batch by batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def append(self, changes: DataFrame, number: int) -> None:
        """Adds a batch; the same number again replaces it."""
        path = f"{self.folder}/rows/batch={number}"
        ordered = changes.repartitionByRange("updated_at").sortWithinPartitions("updated_at")
        ordered.write.mode("overwrite").parquet(path)
        files = self.spark.read.parquet(path).select("updated_at", F.col("_metadata.file_path").alias("file"))
        spans = files.groupBy("file").agg(F.min("updated_at").alias("first"), F.max("updated_at").alias("last"), F.count(F.lit(1)).alias("n"))
        spans.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/batch={number}")

    def since(self, after: Column | None) -> DataFrame | None:
        """The rows changed after a time (all of them without one); None before the first batch."""
        manifest = written(self.spark, f"{self.folder}/manifest")
        if manifest is None:
            return None
        reach = manifest if after is None else manifest.where(F.col("last") > after)
        files = [r["file"] for r in reach.select("file").collect()]  # names of files with changes
        schema = self.spark.read.parquet(f"{self.folder}/rows").drop("batch").schema
        if not files:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*files)
        return rows if after is None else rows.where(F.col("updated_at") > after)

    def deliver(self, name: str) -> DataFrame:
        """What changed since this reader's last delivery, written as its next one.

        Rows are written under the delivery's number, and the watermark, the last time among them,
        after them; an unfinished delivery is written over.
        """
        out = f"{self.folder}/deliveries/{name}"
        marks = written(self.spark, f"{out}/marks")
        last = None if marks is None else marks.agg(F.max_by(F.struct("batch", "mark"), "batch").alias("x")).first()["x"]
        number = 0 if last is None else last["batch"] + 1
        rows = self.since(None if last is None else F.lit(last["mark"]))
        if rows is None:
            raise ValueError("nothing was written to the changelog yet")
        path = f"{out}/rows/batch={number}"
        rows.write.mode("overwrite").parquet(path)
        rows = self.spark.read.schema(rows.schema).parquet(path)
        mark = rows.agg(F.max("updated_at").alias("mark")).where("mark IS NOT NULL")
        if not mark.isEmpty():
            mark.coalesce(1).write.mode("overwrite").parquet(f"{out}/marks/batch={number}")
        return rows
