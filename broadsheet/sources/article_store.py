"""The article table as stored: by shards of sources, bucketed by source and article.

A shard holds the articles of the sources whose hash falls into it and is the unit that a
refresh overwrites; reading a source prunes to its shard.  Within shards rows are bucketed
by source and id, so joins on these two need no exchange of the table, and a heavy source
spreads over all buckets of its shard.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state as st
from .shared import shared_dir, stored

SHARDS = 16
_MODE = "spark.sql.sources.partitionOverwriteMode"


class ArticleStore:
    """Articles in a bucketed table of the session's catalog, at a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, table: str, shards: int):
        self.spark, self.table, self.shards = spark, table, shards

    @classmethod
    def create(cls, articles: DataFrame, shards: int = SHARDS, buckets: int | None = None, path: str | None = None) -> ArticleStore:
        """Stores ``articles``; there are as many ``buckets`` as the session has shuffle partitions, so joins keep them."""
        spark = articles.sparkSession
        store = cls(spark, f"articles_{uuid.uuid4().hex}", shards)
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = articles.withColumn("shard", store.shard_of(F.col("source_id")))
        # rows of a bucket meet in one task, so each shard gets one file a bucket
        rows = rows.repartition(buckets, "source_id", "id").sortWithinPartitions("shard", "source_id", "id")
        at = path or f"{shared_dir(spark)}/{store.table}"
        rows.write.partitionBy("shard").bucketBy(buckets, "source_id", "id").sortBy("source_id", "id").option("path", at).saveAsTable(store.table)
        return store

    def shard_of(self, source_id: Column) -> Column:
        return F.pmod(F.xxhash64(source_id), F.lit(self.shards)).cast("int")

    def rows(self) -> DataFrame:
        """The whole table."""
        return self.spark.table(self.table).drop("shard")

    def of_source(self, source_id: str) -> DataFrame:
        """The articles of a source; only its shard is read."""
        t = self.spark.table(self.table)
        return t.where((F.col("shard") == self.shard_of(F.lit(source_id))) & (F.col("source_id") == source_id)).drop("shard")

    def of_shards(self, shards: list[int]) -> DataFrame:
        return self.spark.table(self.table).where(F.col("shard").isin(shards)).drop("shard")

    def touched(self, sources: DataFrame) -> list[int]:
        """The shards of ``sources`` (``source_id``), as many as the store has at most."""
        return sorted(r["shard"] for r in sources.select(self.shard_of(F.col("source_id")).alias("shard")).distinct().collect())

    def replace(self, incoming: DataFrame, sources: DataFrame, keep: DataFrame) -> list[int]:
        """``state.cache_replace`` in place: the shards of ``sources`` are written anew, all others stay untouched.  Returns these shards.

        The new rows are written aside first, so a failure before the exchange loses nothing and
        a repetition gives the same table.
        """
        shards = self.touched(sources)
        if not shards:
            return []
        after = st.cache_replace(self.of_shards(shards), incoming, sources, keep)
        fresh = stored(after.withColumn("shard", self.shard_of(F.col("source_id"))))
        left = {r["shard"] for r in fresh.select("shard").distinct().collect()}
        mode = self.spark.conf.get(_MODE)
        self.spark.conf.set(_MODE, "dynamic")
        try:
            columns = self.spark.table(self.table).columns
            buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            fresh.select(*columns).repartition(buckets, "source_id", "id").write.insertInto(self.table, overwrite=True)
        finally:
            self.spark.conf.set(_MODE, mode)
        for shard in set(shards) - left:  # nothing is left to overwrite it
            self.spark.sql(f"ALTER TABLE {self.table} DROP IF EXISTS PARTITION (shard = {shard})")
        self.spark.catalog.refreshTable(self.table)
        return shards
