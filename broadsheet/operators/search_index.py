"""Substring search by an inverted index of character trigrams.

Whatever holds a query of three characters or more holds all its trigrams.  The index has the
articles of every trigram of their titles, standfirsts and bylines, in buckets of trigrams, and
how many there are; a search reads the few rarest of the query's trigrams, intersects their
articles and verifies the candidates by the plain search.  Names of feeds are few and looked
through as they are.  Shorter queries scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources.changelog import written
from ..sources.shared import broadcast_if_small, stored
from . import stories as so

BUCKETS = 64
#: Trigrams of a query whose articles are intersected.
RAREST = 4


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text, none across its lines."""
    return let(text, _trigrams)


def _trigrams(text: Column) -> Column:
    at = F.sequence(F.lit(1), F.length(text) - 2)
    grams = F.transform(at, lambda i: F.substring(text, i, F.lit(3)))
    return F.when(F.length(text) > 2, F.filter(F.array_distinct(grams), lambda g: ~g.contains("\n"))).otherwise(F.array().cast("array<string>"))


class TrigramIndex:
    """An index in ``folder``, to which articles are added batch by batch."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def add(self, articles: DataFrame, number: int) -> None:
        """Indexes ``articles`` (``id``, ``title``, ``summary``, ``author``); the same number again replaces a batch."""
        # fields are told apart by a line end, as white space in them is a space
        text = F.concat_ws("\n", *[F.regexp_replace(F.lower(c), "\n", "\u0001") for c in ("title", "summary", "author")])
        rows = articles.select("id", F.explode(trigrams(text)).alias("gram")).withColumn("bucket", self._bucket(F.col("gram")))
        path = f"{self.folder}/postings/batch={number}"
        rows.repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(path)
        counts = self.spark.read.parquet(path).groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("n"))
        counts.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/counts/batch={number}")

    def candidates(self, query: str) -> DataFrame | None:
        """Articles (``id``) with the rarest trigrams of a query; None where it is too short to tell."""
        q = query.strip().lower().replace("\n", "\u0001")
        grams = sorted({q[i : i + 3] for i in range(len(q) - 2)})
        counts = written(self.spark, f"{self.folder}/counts")
        if not grams or counts is None:
            return None
        buckets = [r["b"] for r in self.spark.createDataFrame([(g,) for g in grams], "g string").select(self._bucket(F.col("g")).alias("b")).distinct().collect()]
        mine = lambda t: t.where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
        known = {r["gram"]: r["n"] for r in mine(counts).groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a row a trigram of the query
        rarest = sorted(grams, key=lambda g: (known.get(g, 0), g))[:RAREST]
        rows = mine(written(self.spark, f"{self.folder}/postings")).where(F.col("gram").isin(rarest))
        return rows.groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(rarest)).select("id")

    def search(self, stories: DataFrame, query: str, byline: bool = False) -> DataFrame:
        """``stories.search`` by way of the index."""
        found = self.candidates(query)
        if found is None:
            return so.search(stories, query, byline)
        found = broadcast_if_small(stored(found)).withColumn("hit", F.lit(True))
        named = F.coalesce(F.lower("feed_name").contains(query.strip().lower()), F.lit(False))
        likely = stories.join(found, "id", "left").where(F.coalesce("hit", F.lit(False)) | named)
        return so.search(likely.select(*stories.columns), query, byline)
