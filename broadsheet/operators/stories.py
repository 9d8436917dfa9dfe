"""The read side: stories, views, search, counts and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as tx
from ..functions.blocks import repaired_content_state
from .state import live


#: Feeds that stand in for those of a reader without any.
MOST_FALLBACKS = 1_000


def minutes_ago(ts: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), tx.half_up((F.unix_millis(as_of) - F.unix_millis(ts)) / 60_000))


def shape_feeds(sources: DataFrame) -> DataFrame:
    """The feeds a reader sees: those that weren't removed."""
    return live(sources).select("user_id", F.col("id").alias("feed_id"), F.col("title").alias("name"), "folder", "host", tx.monogram(F.col("title")).alias("mark"), F.col("url").alias("feed_url"), "site_url", F.lit(True).alias("subscribed"))


def shape_stories(articles: DataFrame, as_of: Column, with_body: bool = True) -> DataFrame:
    """Articles as stories; without bodies the stored content state is taken as it is."""
    state = repaired_content_state(F.col("content_state"), F.col("body"), F.col("summary")) if with_body else F.col("content_state")
    return articles.select(
        "id",
        "title",
        F.col("source_id").alias("feed_id"),
        F.col("summary").alias("dek"),
        minutes_ago(F.col("published_at"), as_of).alias("minutes_ago"),
        "minutes",
        "layout",
        "image",
        F.col("author").alias("byline"),
        "link",
        tx.published_label(F.col("published_at")).alias("published_label"),
        state.alias("content_state"),
        F.coalesce("extraction_state", F.lit("idle")).alias("extraction_state"),
        *(["body"] if with_body else []),
    )


def classified(stories: DataFrame, classifications: DataFrame) -> DataFrame:
    """Stories (with ``user_id``) and their topics, none where unclassified."""
    c = classifications.where("deleted_at IS NULL").select("user_id", F.col("item_id").alias("id"), F.col("topic_ids").alias("topics"), F.col("status").alias("classification_status"))
    return stories.join(c, ["user_id", "id"], "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))


def readers_stories(stories: DataFrame, feeds: DataFrame) -> DataFrame:
    """Stories of the feeds that each reader has; the feed side is small and AQE broadcasts it by its size."""
    return stories.join(feeds.select("user_id", "feed_id", F.col("name").alias("feed_name"), "folder", "site_url", "host"), "feed_id")


def view_filter(stories: DataFrame, view: str, reading: DataFrame | None = None) -> DataFrame:
    """One view: ``today``, ``saved``, ``later``, ``folder:X``, ``feed:X`` or ``all``."""
    kind, _, name = view.partition(":")
    if kind == "today":
        return stories.where(F.col("minutes_ago") < fixed.TODAY_MINUTES)
    if kind in ("saved", "later"):
        return flagged(stories, reading, kind)
    if kind == "folder":
        return stories.where(F.col("folder") == name)
    if kind == "feed":
        return stories.where(F.col("feed_id") == name)
    if kind == "all":
        return stories
    raise ValueError(f"no such view: {view}")


def flagged(stories: DataFrame, reading: DataFrame, flag: str) -> DataFrame:
    return stories.join(reading.where(F.col(flag)).select("user_id", F.col("item_id").alias("id")), ["user_id", "id"], "left_semi")


def unread(stories: DataFrame, reading: DataFrame) -> DataFrame:
    return stories.join(reading.where("read").select("user_id", F.col("item_id").alias("id")), ["user_id", "id"], "left_anti")


def search(stories: DataFrame, query: str, byline: bool = False) -> DataFrame:
    """Stories whose title, standfirst or source's name (or byline) holds the query."""
    q = query.strip().lower()
    hit = F.lower("title").contains(q) | F.lower("dek").contains(q) | F.coalesce(F.lower("feed_name").contains(q), F.lit(False))
    if byline:
        hit = hit | F.coalesce(F.lower("byline").contains(q), F.lit(False))
    return stories.where(hit)


def newest(stories: DataFrame, most: int) -> DataFrame:
    """Each reader's ``most`` newest stories: a window with a limit per group, no global sort."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("minutes_ago", "id"))
    return stories.withColumn("rank", rank).where(F.col("rank") <= most)


def palette_search(stories: DataFrame, query: str) -> DataFrame:
    if not query.strip():
        return newest(stories, 7)
    return newest(search(stories, query, byline=True), 24)


def topic_filter(stories: DataFrame, topic: str) -> DataFrame:
    return stories.where(F.array_contains("topics", topic))


def original_url(stories: DataFrame) -> DataFrame:
    url = F.coalesce("link", tx.blank_to_null(F.col("site_url")), F.concat(F.lit("https://"), "host"))
    return stories.withColumn("original_url", url)


def edition_counts(stories: DataFrame, reading: DataFrame) -> DataFrame:
    """(``user_id``, ``scope``, ``name``, ``n``): unread counts of all, today, feeds and folders; all saved and later.

    One pass of grouping sets; folders that a reader has nothing in count 0.
    """
    r = reading.select("user_id", F.col("item_id").alias("id"), "read", "saved", "later")
    s = stories.select("user_id", "id", "feed_id", "folder", "minutes_ago").join(r, ["user_id", "id"], "left")
    fresh = ~F.coalesce("read", F.lit(False))
    s = s.select("user_id", "feed_id", "folder", fresh.cast("long").alias("fresh"), (fresh & (F.col("minutes_ago") < fixed.TODAY_MINUTES)).cast("long").alias("today"), *[F.coalesce(F.col(f), F.lit(False)).cast("long").alias(f) for f in ("saved", "later")])
    g = s.groupingSets([["user_id"], ["user_id", "feed_id"], ["user_id", "folder"]], "user_id", "feed_id", "folder").agg(F.grouping_id().alias("g"), *[F.sum(c).alias(c) for c in ("fresh", "today", "saved", "later")])
    row = lambda scope, name, n: F.struct(F.lit(scope).alias("scope"), name.alias("name"), n.alias("n"))
    none = F.lit(None).cast("string")
    whole = F.array(row("all", none, F.col("fresh")), row("today", none, F.col("today")), row("saved", none, F.col("saved")), row("later", none, F.col("later")))
    # grouping_id: a bit for each column that is summed over (feed_id 2, folder 1)
    rows = F.when(F.col("g") == 3, whole).when(F.col("g") == 1, F.array(row("feed", F.col("feed_id"), F.col("fresh")))).otherwise(F.array(row("folder", F.col("folder"), F.col("fresh"))))
    counts = g.select("user_id", F.inline(rows)).where("scope <> 'folder' OR name IS NOT NULL")
    empty = stories.select("user_id").distinct().select("user_id", F.lit("folder").alias("scope"), F.explode(F.array(*map(F.lit, fixed.FOLDERS))).alias("name"), F.lit(0).cast("long").alias("n"))
    return counts.unionByName(empty).groupBy("user_id", "scope", "name").agg(F.sum("n").alias("n"))


def topic_counts(stories: DataFrame) -> DataFrame:
    return stories.select("user_id", F.explode("topics").alias("topic_id")).groupBy("user_id", "topic_id").agg(F.count(F.lit(1)).alias("n"))


def today_totals(stories: DataFrame) -> DataFrame:
    return view_filter(stories, "today").groupBy("user_id").agg(F.count(F.lit(1)).alias("stories"), F.sum("minutes").alias("minutes"))


def column_stats(stories: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return stories.groupBy("user_id").agg(F.count(F.lit(1)).alias("stories"), F.sum("minutes").alias("minutes"), distinct("feed_id").alias("sources"))


def column_sketches(stories: DataFrame) -> DataFrame:
    """Each reader's column by day (``user_id``, ``day``): stories, minutes and a sketch of their sources, to be stored and merged."""
    day = F.floor(F.col("minutes_ago") / fixed.TODAY_MINUTES).cast("int")
    return stories.groupBy("user_id", day.alias("day")).agg(F.count(F.lit(1)).alias("stories"), F.sum("minutes").alias("minutes"), F.hll_sketch_agg("feed_id").alias("sketch"))


def merged_stats(sketches: DataFrame) -> DataFrame:
    """``column_stats`` of the days in ``sketches``, whichever they are: sketches are merged, stories aren't read again."""
    g = sketches.groupBy("user_id").agg(F.sum("stories").alias("stories"), F.sum("minutes").alias("minutes"), F.hll_union_agg("sketch").alias("sketch"))
    return g.select("user_id", "stories", "minutes", F.hll_sketch_estimate("sketch").alias("sources"))


#: Minutes of a segment of a reader's column.
SEGMENT = 1_440


def _segmented(stories: DataFrame, span: int) -> DataFrame:
    return stories.withColumn("segment", F.floor(F.col("minutes_ago") / span))


def stream_order(stories: DataFrame, span: int = SEGMENT) -> DataFrame:
    """Each reader's column in order: newest first, by id where equally old.

    Columns are ranked in segments of ``span`` minutes, and a second pass over the sizes of
    segments adds what stands before each, so no task holds all of a reader's stories.
    """
    s = _segmented(stories, span)
    sizes = s.groupBy("user_id", "segment").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("user_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("user_id", "segment").orderBy("minutes_ago", "id"))
    s = s.withColumn("rank", rank).join(sizes.select("user_id", "segment", before.alias("before")), ["user_id", "segment"])
    return s.withColumn("rank", (F.col("rank") + F.col("before")).cast("int")).select(*stories.columns, "rank")


def sources_order(sources: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("added_at"), "id"))
    return live(sources).withColumn("rank", rank)


def sweep_order(stories: DataFrame, opened: DataFrame) -> DataFrame:
    """The order in which to classify: a reader's open story first, then the newest."""
    s = stories.join(opened.select("user_id", F.col("item_id").alias("open_id")), "user_id", "left")
    first = F.coalesce((F.col("id") == F.col("open_id")).cast("int"), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(first.desc(), "minutes_ago", "id"))
    return s.withColumn("rank", rank).drop("open_id")


def up_next(stories: DataFrame, reading: DataFrame, span: int = SEGMENT) -> DataFrame:
    """For every story of the whole column its neighbours among the unread ones.

    Neighbours are looked for in segments of ``span`` minutes; where a segment has none, the
    first or last unread story of the next one that has any is carried across, in a pass over
    segments.  No task holds all of a reader's stories.
    """
    r = reading.where("read").select("user_id", F.col("item_id").alias("id"), F.lit(True).alias("gone"))
    s = _segmented(stories.select("user_id", "id", "minutes_ago"), span).join(r, ["user_id", "id"], "left")
    s = s.select("user_id", "segment", "id", "minutes_ago", F.when(F.col("gone").isNull(), F.col("id")).alias("seen"))
    place = F.when(F.col("seen").isNotNull(), F.struct("minutes_ago", "id"))
    edges = s.groupBy("user_id", "segment").agg(F.min(place)["id"].alias("first"), F.max(place)["id"].alias("last"))
    by_segment = Window.partitionBy("user_id").orderBy("segment")
    later = F.first("first", True).over(by_segment.rowsBetween(1, Window.unboundedFollowing))
    earlier = F.last("last", True).over(by_segment.rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.select("user_id", "segment", later.alias("later"), earlier.alias("earlier"))
    w = Window.partitionBy("user_id", "segment").orderBy("minutes_ago", "id")
    after = F.first("seen", True).over(w.rowsBetween(1, Window.unboundedFollowing))
    before = F.last("seen", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("after", after).withColumn("before", before).join(edges, ["user_id", "segment"])
    return s.select("user_id", "id", F.coalesce("after", "later").alias("next_id"), F.coalesce("before", "earlier").alias("previous_id"))


def count_deltas(old: DataFrame, new: DataFrame, stories: DataFrame) -> DataFrame:
    """(``user_id``, ``scope``, ``name``, ``n``): what ``edition_counts`` gains or loses where reading rows ``old`` become ``new``.

    ``old`` needs the rows of the keys in ``new`` only; a key without one had no flag set.
    """
    keys, flags = ["user_id", "id"], ["read", "saved", "later"]
    a, b = (t.select("user_id", F.col("item_id").alias("id"), F.struct(*flags).alias(n)) for t, n in ((old, "a"), (new, "b")))
    s = stories.select(*keys, "feed_id", "folder", "minutes_ago").join(b.join(a, keys, "left"), keys)
    on = lambda side, flag: F.coalesce(F.col(f"{side}.{flag}"), F.lit(False)).cast("long")
    fresh = on("a", "read") - on("b", "read")
    row = lambda scope, name, n: F.struct(F.lit(scope).alias("scope"), name.alias("name"), n.alias("n"))
    none = F.lit(None).cast("string")
    today = F.when(F.col("minutes_ago") < fixed.TODAY_MINUTES, fresh).otherwise(F.lit(0))
    rows = F.array(row("all", none, fresh), row("today", none, today), row("saved", none, on("b", "saved") - on("a", "saved")), row("later", none, on("b", "later") - on("a", "later")), row("feed", F.col("feed_id"), fresh), row("folder", F.col("folder"), fresh))
    d = s.select("user_id", F.inline(rows)).where("n <> 0 AND (scope <> 'folder' OR name IS NOT NULL)")
    return d.groupBy("user_id", "scope", "name").agg(F.sum("n").alias("n"))


def folders_in_use(feeds: DataFrame) -> DataFrame:
    return feeds.where("folder IS NOT NULL").select("user_id", "folder").distinct()


def feed_union(feeds: DataFrame, fallback: DataFrame, users: DataFrame) -> DataFrame:
    """Readers' feeds, or the fallback ones (a short list, ``MOST_FALLBACKS`` at most) for a reader without any."""
    bare = users.select("user_id").distinct().join(feeds.select("user_id").distinct(), "user_id", "left_anti")
    rows = fallback.limit(MOST_FALLBACKS + 1).collect()
    if len(rows) > MOST_FALLBACKS:
        raise ValueError(f"more than {MOST_FALLBACKS} fallback feeds")
    rest = [c for c in feeds.columns if c != "user_id"]
    if not rows:
        return feeds
    given = F.array(*[F.struct(*[F.lit(r[c]).cast(feeds.schema[c].dataType).alias(c) for c in rest]) for r in rows])
    return feeds.unionByName(bare.select("user_id", F.inline(given)).select(*feeds.columns))
