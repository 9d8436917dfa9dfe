"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the ``k`` smallest distinct 64-bit hashes of a text's word
shingles.  Sketches of parts merge into the sketch of the whole, and two of
them estimate resemblance, containment and the number of distinct shingles.
While a text has no more than ``k`` shingles all of these are exact.

Defined results: a null text counts as empty and has an empty sketch; two
empty sketches have resemblance 1, an empty and another one 0.  A text of fewer
words than a shingle is one shingle.  The edited text of the last document (in
descending id order, ties by text) continues with the first.  Null ids come
last.  Repeated rows are handled each.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, range_bounds, range_part
from .hashing import LOWER, buffers, hash_words, shingles, slices

WORDS = 5
K = 128
#: Rows of a partition, about.
PART_ROWS = 2048


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """Bottom-k sketch of distinct hashes that are sorted."""
    return hashes[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / (float(a[-1]) + 1)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity: the share of the union's sketch that lies in both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:] == both[:-1]
    union = both[np.concatenate([[True], ~twice])][:k]
    return float(np.count_nonzero(both[1:][twice] <= union[-1])) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    r = resemblance(a, b, k)
    union = distinct(merge(a, b, k), k)
    return min(1.0, r * union / distinct(a, k))


def encode(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def decode(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), "<u8").astype(np.uint64)


def sketches(texts: pa.Array, words: int = WORDS, k: int = K) -> list[np.ndarray]:
    """Sketches of a column of texts; A-Z count as lower case."""
    data, offs = buffers(texts)
    hashes, first = hash_words(LOWER[data], offs)
    return [sketch(shingles(hashes[i:j], words), k) for i, j in zip(first[:-1], first[1:])]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, k: int = K) -> DataFrame:
    """``doc_id``, ``n_shingles`` (estimated) and ``fingerprint`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sketches(batch.column(1), words, k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([distinct(s, k) for s in found], pa.float64()), pa.array([encode(s) for s in found], pa.string())], names=["doc_id", "n_shingles", "fingerprint"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_shingles double, fingerprint string")


def _with_next(docs: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Rows (``part``, ``real``, ``doc_id``, ``text``), a part in a partition: in descending
    order each document is followed by the next of all, because the last row of a part,
    not ``real``, is a copy of the following part's first document."""
    ids = checkpoint(docs.select("doc_id"))
    bounds = range_bounds(ids, "doc_id", part_rows)
    part = range_part(F.col("doc_id"), bounds)  # ascending: the following part has a lower number
    firsts = ids.groupBy(part.alias("part")).agg(F.max("doc_id").alias("first"))
    order = Window.orderBy(F.desc("part"))  # one row per part
    firsts = firsts.withColumn("to", F.coalesce(F.lag("part").over(order), F.min("part").over(Window.partitionBy())))
    firsts = F.broadcast(checkpoint(firsts.select("first", "to")))  # at most 65,536 rows
    copies = docs.join(firsts, F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("to").agg(F.min("text").alias("text"))
    rows = docs.select(part.alias("part"), F.lit(True).alias("real"), "doc_id", "text")
    rows = rows.unionByName(copies.select(F.col("to").alias("part"), F.lit(False).alias("real"), F.lit(None).cast("long").alias("doc_id"), "text"))
    return rows.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", F.desc("real"), F.col("doc_id").desc_nulls_last(), "text")


def edited_text(text: str, following: str) -> str:
    """``text`` with its second half replaced by as much of the following text's beginning."""
    cut = len(text) // 2
    return text[: len(text) - cut] + following[:cut]


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, k: int = K) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for whole in batches:
            for batch in slices(whole, "text"):
                found = sketches(batch.column("text"), words, k)
                rows = list(zip(batch.column("real").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), found))
                if held:
                    rows.insert(0, held)
                held = rows[-1]
                pairs = [(a, b) for a, b in zip(rows[:-1], rows[1:]) if a[0]]
                texts = [edited_text(a[2], b[2]) for a, b in pairs]
                edited = sketches(pa.array(texts, pa.string()), words, k)
                columns = {
                    "doc_id": pa.array([a[1] for a, _ in pairs], pa.int64()),
                    "n_chars": pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
                    "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                    "fingerprint": pa.array([encode(a[3]) for a, _ in pairs], pa.string()),
                    "edited_fingerprint": pa.array([encode(e) for e in edited], pa.string()),
                    "near_edited": pa.array([resemblance(a[3], e, k) for (a, _), e in zip(pairs, edited)], pa.float64()),
                    "near_next": pa.array([resemblance(a[3], b[3], k) for a, b in pairs], pa.float64()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _with_next(slim).mapInArrow(run, schema)
