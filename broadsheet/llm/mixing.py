"""Mixing sources to target weights.

Every document gets a hash-random key.  Within a source, documents follow
each other by key; the key space is cut into equal buckets, word counts are
summed per (source, bucket) and a running sum over those few rows finds the
bucket in which a source's budget ends.  Only the documents of that bucket are
ordered to find the exact cut.  A budget above the source's size takes whole
epochs first.  A document then decides by itself, from its key and its source's
cut, how often it is taken: texts are never shuffled or collected.

Defined results: a null text has size 0.  A null source is a source of its
own, last in order.  Rows that repeat id and text share a key: where the cut
falls among them, each gets an equal whole number of the words left.  An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, checkpoint, n_words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
#: Documents per bucket, about; fixes how many rows the last ordering sees.
BUCKET_ROWS = 4096


def _key(doc_id: Column, text: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("-")), F.md5(F.coalesce(text, F.lit("")))))


def _running(df: DataFrame, order: list[Column], **values: Column) -> DataFrame:
    """Adds the sums of ``values`` over all rows before each one in an order that has no ties.

    Rows are sorted by ranges; the sums of the ranges, a row each, give what stands before a
    range, and a window within it the rest.  No task holds more than a range.
    """
    # written, so that rows stay in the ranges that they were counted in
    rows = checkpoint(df.withColumns(values).repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    totals = rows.groupBy("__range").agg(*[F.sum(v).alias(v) for v in values]).orderBy("__range").collect()  # a row a partition
    before, so_far = [], {v: 0 for v in values}
    for t in totals:
        before.append((t["__range"], *[float(so_far[v]) for v in values]))
        so_far = {v: so_far[v] + t[v] for v in values}
    names = ", ".join(f"__{v} double" for v in values)
    starts = df.sparkSession.createDataFrame(before, f"__r int, {names}")
    run = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(F.broadcast(starts), F.col("__range") == F.col("__r"))
    rows = rows.withColumns({v: F.col(f"__{v}") + F.coalesce(F.sum(v).over(run), F.lit(0)) for v in values})
    return rows.drop("__range", "__r", *[f"__{v}" for v in values])


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Water-filling over one row per source (``source``, ``source_size``): adds ``target``.

    Sources by code point, null last, weigh ``weights`` in turn.  A source is
    full when the common level ``budget / weight`` passes its cap over its
    weight, so the full ones are a prefix in the order of that ratio.  Both orders are
    sums over ranges, so there may be as many sources as there are hosts.
    """
    by_source = F.col("source").asc_nulls_last()
    w = _running(sizes, [by_source], place=F.lit(1.0))
    w = w.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("place").cast("long"), F.lit(len(weights))).cast("int") + 1))
    w = w.withColumn("cap", F.col("source_size") * float(max_epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    w = checkpoint(_running(w.drop("place"), [F.col("ratio"), by_source], caps=F.col("cap"), weighed=F.col("weight")))
    whole = w.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    all_words = float(whole["words"] or 0) * float(share)
    rest = F.lit(float(whole["weight"] or 0)) - F.col("weighed") - F.col("weight")
    w = w.withColumn("full", F.col("caps") + F.col("cap") + F.col("ratio") * rest <= F.lit(all_words))
    left = w.agg(F.sum(F.when(F.col("full"), F.col("cap"))).alias("caps"), F.sum(F.when(~F.col("full"), F.col("weight"))).alias("weight")).first()
    level = (all_words - float(left["caps"] or 0)) / left["weight"] if left["weight"] else 0.0
    return w.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def _number(key: Column) -> Column:
    """The key's first 8 digits: its place in a 32-bit space."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long")


def _rules(slim: DataFrame, weights, share: float, max_epochs: int) -> DataFrame:
    """One row per source, from rows (``source``, ``key``, ``size``).

    ``epochs`` whole rounds are taken; then the keys below ``cut`` once more,
    and ``part`` words of the cut's own document.
    """
    per_source = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    goals = targets(per_source.select("source", "source_size"), weights, share, max_epochs)
    goals = goals.join(per_source.select(F.col("source").alias("__s"), "rows"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    budget = F.floor(F.col("target") + F.lit(1e-6)).cast("long")
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    goals = goals.withColumn("more", budget - F.col("epochs") * F.col("source_size"))
    goals = checkpoint(goals.withColumn("buckets", F.ceil(F.col("rows") / BUCKET_ROWS).cast("long")))

    of = broadcast_if_small(goals.select(F.col("source").alias("__s"), "buckets", "more"))
    rows = slim.join(of, F.col("source").eqNullSafe(F.col("__s"))).withColumn("bucket", F.shiftright(_number(F.col("key")) * F.col("buckets"), 32))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.max("more").alias("more"))
    within = (F.col("before") <= F.col("more")) & (F.col("more") < F.col("before") + F.col("words"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0))).where(within)
    ends = broadcast_if_small(checkpoint(ends.select(F.col("source").alias("__e"), F.col("bucket").alias("__b"), "before")))
    inside = rows.join(ends, F.col("source").eqNullSafe(F.col("__e")) & (F.col("bucket") == F.col("__b")))
    # rows with one key count as one, with their words together
    keys = inside.groupBy("source", "bucket", "key").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("alike"), F.max("more").alias("more"), F.max("before").alias("start"))
    run = Window.partitionBy("source", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    cut = keys.withColumn("before", F.col("start") + F.coalesce(F.sum("words").over(run), F.lit(0))).where(within)
    cut = cut.select(F.col("source").alias("__s"), F.col("key").alias("cut"), F.floor((F.col("more") - F.col("before")) / F.col("alike")).cast("long").alias("part"))
    goals = goals.join(cut, F.col("source").eqNullSafe(F.col("__s")), "left").select(F.col("source").alias("__s"), "source_size", F.col("target").cast("double").alias("target"), "epochs", "cut", "part")
    return broadcast_if_small(checkpoint(goals))


def _taken(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``taken`` to rows with ``source``, ``key`` and ``size``."""
    out = rows.join(rules, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    extra = F.when(F.col("key") < F.col("cut"), F.col("size")).when(F.col("key") == F.col("cut"), F.col("part")).otherwise(F.lit(0))
    return out.withColumn("taken", (F.col("epochs") * F.col("size") + extra).cast("long"))


def _slim(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text).alias("size"), _key(F.col(id_col), text, seed).alias("key"))


def plan(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS, seed=0) -> DataFrame:
    """One row per document: id, source, ``size``, ``source_size``, ``target``, ``taken`` (words)."""
    slim = checkpoint(_slim(docs, id_col, text_col, source_col, seed))
    rows = _taken(slim, _rules(slim, weights, share, max_epochs))
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", n_chars_col="n_chars", weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS, seed=0) -> DataFrame:
    """The mixed corpus: a row per copy taken; the document that a cut splits ends after its last word taken.

    ``n_chars_col``, if there, follows the text.
    """
    slim = checkpoint(_slim(docs, id_col, text_col, source_col, seed))
    rules = _rules(slim, weights, share, max_epochs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = F.col(text_col)
    rows = docs.select(row, F.col(source_col).alias("source"), n_words(text).alias("size"), _key(F.col(id_col), text, seed).alias("key"))
    rows = _taken(rows, rules).where("taken > 0")
    left = F.col("taken") % F.col("size")
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), F.floor(F.col("taken") / F.col("size")).cast("int")), F.when(left > 0, F.array(left)).otherwise(F.array().cast("array<bigint>")))
    rows = rows.select("row", F.explode(copies).alias("words"))
    pieces = F.regexp_extract_all(F.col("row")[text_col], F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1))
    text = F.when(F.col("words") > 0, F.array_join(F.slice(pieces, F.lit(1), F.col("words").cast("int")), "")).otherwise(F.col("row")[text_col])
    out = rows.select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
    if n_chars_col in docs.columns:
        out = out.withColumn(n_chars_col, F.length(text_col).cast(docs.schema[n_chars_col].dataType))
    return out
