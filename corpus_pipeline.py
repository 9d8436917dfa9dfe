"""From raw documents to packed training windows.

Each stage gets what its predecessor kept and returns a DataFrame; all but the
last return the columns of ``documents``, whatever other columns there are.

Each stage stands nulls in any column, empty and very long texts, ties, repeated rows,
empty tables and columns named like its own; what becomes of them is said at each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from broadsheet.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from broadsheet.llm.common import shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted grade of toxicity is above 0 go.

    Null and empty texts have no features and stay, as everything does where no label tells.
    Repeated rows share their fate.  Null ids are judged by their texts.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays.

    Null counts as an empty text.  Null ids are the smallest; of rows that repeat the largest
    id one stays.
    """
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles (similarity 0.8 or more) the one with the smallest id stays.

    Texts without words are linked with nothing and stay, and so do null ids.  Of several
    texts with the smallest id the one with the smallest hash stays, of repeated rows one.
    """
    return near_dedup.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; a document taken twice is there twice.

    A null source is a source of its own, last in order.  Texts without words have size 0 and are
    never taken.  Rows that repeat id and text share the words that are left where a cut falls on them.
    """
    return mixing.mix(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, each with its place in a training window.

    A null or empty text is its end id alone.  Repeated rows are packed each; null ids stay null.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Trained scores, similarity trees and tokenizers have no SQL twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
