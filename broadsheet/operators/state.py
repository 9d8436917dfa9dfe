"""Keyed changelogs: latest rows, upserts, incremental changes and merges of reader state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lww_latest(changes: DataFrame, keys: list[str], ties: str = "last", at: str = "updated_at", seq: str = "seq") -> DataFrame:
    """The latest row of each key.

    ``ties`` of time: ``"last"`` arrival wins (reading, classifications), or a
    ``"deletion"`` wins, then the first arrival (sources, topics).  One partial
    aggregate: a key's rows are never brought together unreduced.
    """
    rest = [c for c in changes.columns if c not in keys]
    row = F.struct(*rest)
    if ties == "last":
        order = F.struct(at, seq)
    else:
        order = F.struct(at, F.col("deleted_at").isNotNull(), -F.col(seq))
    best = changes.groupBy(*keys).agg(F.max_by(row, order).alias("row"))
    return best.select(*keys, "row.*").select(*changes.columns)


def live(table: DataFrame) -> DataFrame:
    """Rows that aren't tombstones."""
    return table.where(F.col("deleted_at").isNull())


def upsert(table: DataFrame, incoming: DataFrame, keys: list[str], position: str = "position") -> DataFrame:
    """``table`` with whole rows replaced or added by key; of equal keys the last by ``position`` counts."""
    fields = [c for c in table.columns if c not in keys]
    fresh = incoming.groupBy(*keys).agg(F.max_by(F.struct(*fields), position).alias("row")).select(*keys, "row.*")
    kept = table.join(fresh.select(*keys), keys, "left_anti")
    return kept.unionByName(fresh.select(*table.columns))


def changes_since(tables: dict[str, DataFrame], watermark: Column, keys: dict[str, list[str]]) -> DataFrame:
    """(``store``, ``key``, ``updated_at``, ``deleted``, ``row`` as JSON) of rows changed after the watermark."""
    out = None
    for name, table in tables.items():
        deleted = F.col("deleted_at").isNotNull() if "deleted_at" in table.columns else F.lit(False)
        rows = table.where(F.col("updated_at") > watermark)
        rows = rows.select(F.lit(name).alias("store"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys[name]]).alias("key"), "updated_at", deleted.alias("deleted"), F.to_json(F.struct(*table.columns)).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    return out


def merge(local: DataFrame, incoming: DataFrame, keys: list[str], ties: str) -> DataFrame:
    """Two states of one store, one row a key in each, as one.

    With ``ties="deletion"`` incoming wins if newer, or equally old and deleted
    while the local one isn't; with ``ties="last"`` if not older.
    """
    fields = [c for c in local.columns if c not in keys]
    a = local.select(*keys, F.struct(*fields).alias("a"))
    b = incoming.select(*keys, F.struct(*fields).alias("b"))
    both = a.join(b, keys, "full_outer")
    newer = F.col("b.updated_at") > F.col("a.updated_at")
    tie = F.col("b.updated_at") == F.col("a.updated_at")
    if ties == "deletion":
        wins = newer | (tie & F.col("b.deleted_at").isNotNull() & F.col("a.deleted_at").isNull())
    else:
        wins = newer | tie
    row = F.when(F.col("a").isNull() | wins, F.col("b")).otherwise(F.col("a"))
    return both.select(*keys, row.alias("row")).select(*keys, "row.*").select(*local.columns)


def tombstone(table: DataFrame, gone: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """Rows named in ``gone`` marked as deleted; unknown names are ignored."""
    hit = gone.select(*keys).distinct().withColumn("__hit", F.lit(True))
    rows = table.join(hit, keys, "left")
    mark = lambda c: F.when(F.col("__hit"), at).otherwise(F.col(c)).alias(c)
    return rows.select(*[mark(c) if c in ("updated_at", "deleted_at") else F.col(c) for c in table.columns])


def reading_flags(reading: DataFrame) -> DataFrame:
    """(``user_id``, ``item_id``, ``flag``) of every flag that is set."""
    flags = reading.unpivot(["user_id", "item_id"], ["read", "saved", "later"], "flag", "is_set")
    return flags.where("is_set").drop("is_set")


def reading_patch(reading: DataFrame, actions: DataFrame, at: Column) -> DataFrame:
    """New reading rows for ``actions`` (``user_id``, ``item_id``, ``action``: toggle_read, toggle_saved, toggle_later or mark_read).

    A row is made where there is none; ``mark_read`` leaves read items alone.
    """
    known = reading.select("user_id", "item_id", "read", "saved", "later")
    rows = actions.join(known, ["user_id", "item_id"], "left").fillna(False, ["read", "saved", "later"])
    rows = rows.where((F.col("action") != "mark_read") | ~F.col("read"))
    flip = lambda flag: (F.when(F.col("action") == f"toggle_{flag}", ~F.col(flag)).otherwise(F.col(flag) | ((F.col("action") == "mark_read") & F.lit(flag == "read")))).alias(flag)
    return rows.select("user_id", "item_id", flip("read"), flip("saved"), flip("later"), at.alias("updated_at"))


def cache_replace(articles: DataFrame, incoming: DataFrame, sources: DataFrame, keep: DataFrame) -> DataFrame:
    """``articles`` after a refresh of ``sources``: what the feed no longer has goes, unless kept.

    ``incoming`` are whole article rows, ``sources`` has ``source_id``, ``keep`` has ``id``.
    """
    touched = articles.join(sources.select("source_id").distinct(), "source_id", "left_semi")
    untouched = articles.join(sources.select("source_id").distinct(), "source_id", "left_anti")
    old = touched.join(incoming.select("id"), "id", "left_anti").join(keep.select("id").distinct(), "id", "left_semi")
    return untouched.unionByName(old).unionByName(incoming.select(*articles.columns))


def remove_source(sources: DataFrame, articles: DataFrame, gone: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Sources (tombstoned) and articles (dropped where no reader has the source any more)."""
    after = tombstone(sources, gone, ["user_id", "id"], at)
    lost = gone.select(F.col("id").alias("source_id")).distinct().join(live(after).select(F.col("id").alias("source_id")), "source_id", "left_anti")
    return after, articles.join(lost, "source_id", "left_anti")


def item_cap(items: DataFrame, most: int, source: str = "source_id", pos: str = "pos") -> DataFrame:
    """The first items of each source."""
    rank = F.row_number().over(Window.partitionBy(source).orderBy(pos))
    return items.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")
