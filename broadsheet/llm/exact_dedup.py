"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary (Spark's ``freqItems``) names the digests that may be
frequent.  Their exact counts and winners are verified, broadcast (at most
``1 / support`` rows) and looked up map-side, so a digest that a third of all
rows share never meets in one task.  All other digests are pre-aggregated and
joined by ordinary shuffles of digests; texts are never shuffled to decide.

Defined results: a null text counts as the empty text.  Of equal texts the
row with the largest id stays; null ids are smaller than any other.  Rows that
repeat both id and text all carry ``kept`` when theirs is the largest id;
``deduplicate`` leaves one of them.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Largest share of rows that a digest may have on the ordinary path.
SUPPORT = 1 / 2000


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    slim = checkpoint(docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256")))
    winner = [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]

    frequent = slim.stat.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    heavy = slim.join(F.broadcast(frequent), "text_sha256", "left_semi").groupBy("text_sha256").agg(*winner)
    # false positives of the summary are dropped: the list stays within 2 / support rows
    heavy = heavy.where((F.col("group_size") > slim.count() * support / 2) & (F.col("group_size") > 1))
    heavy = checkpoint(heavy)

    rows = slim.join(F.broadcast(heavy), "text_sha256", "left")
    settled = rows.where(F.col("group_size").isNotNull())
    rest = rows.where(F.col("group_size").isNull()).select("doc_id", "text_sha256")
    rest = rest.join(rest.groupBy("text_sha256").agg(*winner), "text_sha256")
    names = ["doc_id", "keep_id", "group_size", "text_sha256"]
    return settled.select(*names).unionByName(rest.select(*names)).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat id and text one."""
    decided = checkpoint(decisions(docs, id_col, text_col, support))
    pair = ["id", "digest"]
    # the caller's columns travel as one, so that no name clashes
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest"))
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["digest"] == b["digest"])
    named = decided.select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest"), "kept")
    lost = named.where(~F.col("kept")).select(*pair).distinct()
    stay = rows.join(lost, same(rows, lost), "left_anti")
    repeated = checkpoint(named.where("kept").groupBy(*pair).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*pair))
    if not repeated.isEmpty():
        once = stay.join(repeated, same(stay, repeated), "left_anti")
        stay = once.unionByName(stay.join(repeated, same(stay, repeated), "left_semi").dropDuplicates(pair))
    return stay.select("row.*")
