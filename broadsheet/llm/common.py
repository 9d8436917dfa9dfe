"""Small helpers that the operators share."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters outside ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and all runs on one machine, as in tests, a
    temporary folder is made and set.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``checkpoint``, as a Parquet table: smaller, for wide rows or repeated values."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Removes the files of a table that ``stored`` wrote and nothing reads any more."""
    jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/table-" not in name:
            raise ValueError(f"not a stored table: {name}")
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if it has few rows, else as it is, for a shuffled join.

    ``df`` should be cheap to count: a checkpoint or a small aggregate of one.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def range_bounds(ids: DataFrame, column: str, part_rows: int, most: int = 65_536) -> list[int]:
    """Ascending lower bounds of all parts but the first, for parts of about ``part_rows`` rows.

    They come from a sample that depends on the ids alone, so equal tables get
    equal bounds however they are stored.  ``ids`` is read three times.
    """
    n = ids.count()
    parts = min(most, max(1, n // part_rows))
    every = max(1, n // (32 * parts))
    id_ = F.col(column)
    sample = ids.where(id_.isNotNull() & (F.pmod(F.xxhash64(id_), F.lit(every)) == 0)).select(id_.alias("id")).distinct()
    rank = F.percent_rank().over(Window.orderBy("id"))  # of at most some 32 rows a part
    firsts = sample.select("id", F.least(F.floor(rank * parts), F.lit(parts - 1)).alias("p")).groupBy("p").agg(F.min("id").alias("id"))
    return sorted(r["id"] for r in firsts.collect())[1:]


def range_part(id_: Column, bounds: list[int], wide: int = 256) -> Column:
    """The part of an id: how many bounds are not above it; null ids go to the first part.

    A search in two steps keeps it a built-in expression for thousands of bounds.
    """
    if not bounds:
        return F.lit(0)
    groups = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    outer = F.from_json(F.lit(json.dumps([g[0] for g in groups])), "array<bigint>")
    inner = F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>")
    below = lambda values: F.size(F.filter(values, lambda b: b <= id_))
    group = below(outer)
    part = F.when(group == 0, 0).otherwise((group - 1) * wide + below(F.element_at(inner, group)))
    return F.coalesce(part, F.lit(0))


def n_words(text: Column) -> Column:
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables in which the rows of a key are never split, from batches sorted by it."""
    import pyarrow.compute as pc

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        same = pc.equal(keys, keys[-1])
        # first row of the last key in this batch
        first = pc.index(same, True).as_py()
        if held and held[-1].column(key)[-1] != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        if first:
            yield pa.Table.from_batches([*held, batch.slice(0, first)])
            held = []
        held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)
