"""Whole jobs made of the operators: feed refresh, edition, page update."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..operators import pages as pg
from ..operators import refresh as rf
from ..operators import state as st
from ..operators import stories as so
from ..sources import feeds as fd
from ..sources.shared import broadcast_if_small, stored


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def store_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(``store``, ``n``): live rows of each store."""

    def one(name: str, t: DataFrame) -> DataFrame:
        rows = st.live(t) if "deleted_at" in t.columns else t
        return rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("store"), "n")

    return union_all([one(n, t) for n, t in tables.items()])


def subscribe(items: DataFrame, articles: DataFrame, at: Column) -> DataFrame:
    """Article rows of new sources: their first items, reconciled with an empty cache."""
    return rf.reconcile(st.item_cap(items, fixed.SOURCE_ITEMS).drop("pos"), articles.limit(0), at).drop("rebuilt")


def feed_changes(documents: DataFrame, sources: DataFrame, articles: DataFrame, at: Column, stale_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """What the feeds in ``documents`` change: article rows of changed sources, and (``source_id``, ``changed``) of all that were read."""
    due = (rf.sources_stale(sources, at) if stale_only else st.live(sources)).select(F.col("url").alias("feed_url"), F.col("id").alias("source_id")).distinct()
    due = broadcast_if_small(stored(due))
    read = fd.items(fd.parse(documents.join(due, "feed_url", "left_semi")), fixed.SOURCE_ITEMS)
    items = stored(read.drop("identity"), "zstd").join(due, "feed_url")  # parsed once
    # sources of several feeds have more than their items yet; bodies stay where they are
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy("pos"))
    ranked = stored(rf.slim(items).withColumn("rank", rank))
    beyond = ranked.groupBy("source_id", "feed_url", "pos").agg(F.min("rank").alias("rank")).where(F.col("rank") > fixed.SOURCE_ITEMS)
    beyond = broadcast_if_small(stored(beyond.drop("rank")))
    capped = lambda t: t.drop("feed_url", "pos", "rank")
    kept = items.join(beyond, ["source_id", "feed_url", "pos"], "left_anti")
    return rf.refresh_changes(capped(kept), articles, at, capped(ranked.where(F.col("rank") <= fixed.SOURCE_ITEMS)))


def feed_refresh(documents: DataFrame, sources: DataFrame, articles: DataFrame, reading: DataFrame, at: Column, stale_only: bool = False) -> DataFrame:
    """The article table after the feeds in ``documents`` were read; rows of unchanged sources are passed on as they are."""
    incoming, verdicts = feed_changes(documents, sources, articles, at, stale_only)
    return st.cache_replace(articles, incoming, verdicts.where("changed").select("source_id"), kept_items(reading))


def kept_items(reading: DataFrame) -> DataFrame:
    """Articles (``id``) that stay although their feed has lost them."""
    return reading.where("saved OR later").select(F.col("item_id").alias("id"))


def edition(articles: DataFrame, sources: DataFrame, classifications: DataFrame, reading: DataFrame, as_of: Column, view: str = "all", most: int = 50, query: str | None = None, topic: str | None = None) -> DataFrame:
    """Each reader's unread column under a view, search and topic; the newest ``most`` stories.

    Bodies aren't read, and "today" is pushed to the scan as a bound on the publication time.
    """
    if view == "today":
        articles = articles.where(F.col("published_at") > F.timestamp_millis(F.unix_millis(as_of) - (fixed.TODAY_MINUTES + 1) * 60_000))
    stories = so.readers_stories(so.shape_stories(articles, as_of, with_body=False), so.shape_feeds(sources))
    stories = so.classified(stories, classifications)
    stories = so.search(stories, query) if query else so.view_filter(stories, view, reading)
    if topic:
        stories = so.topic_filter(stories, topic)
    return so.newest(so.unread(stories, reading), most)


def page_update(articles: DataFrame, pages: DataFrame, at: Column) -> DataFrame:
    """The article table after the pages of all articles that are due were read.

    Only pages that a due article links to are parsed.
    """
    due = articles.where(rf.article_refresh_due(at)).select(F.col("link").alias("url")).distinct()
    # each page is parsed once
    read = pg.extract(pages.select("url", "html").join(due, "url", "left_semi"))
    fields = {"outcome": F.when(F.col("error").isNull(), "ok").otherwise("failed"), "etag": F.lit(None).cast("string"), "last_modified": F.lit(None).cast("string")}
    outcomes = read.withColumns(fields).withColumnRenamed("url", "link").dropDuplicates(["link"])
    return rf.apply_extraction(articles, outcomes, at)
