"""Registered queries of the feed and article library, each with a SQL twin where SQL can say it.

Every query reads the driver's tables through ``sources.views``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed
from .functions import blocks as bl
from .functions import html as hx
from .functions import text as tx
from .functions import urls
from .operators import classification as cl
from .operators import pages as pg
from .operators import refresh as rf
from .operators import state as st
from .operators import stories as so
from .operators.search_index import TrigramIndex
from .plans import workloads as wl
from .sources import feeds as fd
from .sources import views as vw
from .sources.article_store import ArticleStore
from .sources.shared import shared_dir
from .streaming import streams as sm

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


W = vw.with_views
NOW = f"TIMESTAMP '{vw.AS_OF}'"
_MIN = f"greatest(1, floor((epoch_ms({NOW}) - epoch_ms(a.published_at)) / 60000.0::DOUBLE + 0.5))::BIGINT"
_FNV = "CASE WHEN {0} = '' THEN 2166136261 ELSE list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) END"
#: Readers' stories: articles of each reader's feeds.
_STORIES = f"""stories AS (SELECT s.user_id, a.id, a.title, a.source_id AS feed_id, a.summary AS dek, a.author AS byline, a.link, {_MIN} AS minutes_ago, a.minutes, s.title AS feed_name, s.folder, s.site_url, s.host
  FROM articles a JOIN sources s ON a.source_id = s.id AND s.deleted_at IS NULL)"""


def S(body: str, *views: str) -> str:
    """SQL over readers' stories."""
    return W("", "sources", "articles", *views).rstrip() + f",\n{_STORIES}\n{body}"


def _stories(spark: SparkSession, d: str, with_body: bool = False) -> DataFrame:
    s = so.shape_stories(vw.articles(spark, d), vw.now(), with_body)
    return so.readers_stories(s, so.shape_feeds(vw.sources(spark, d)))


def _reading(spark: SparkSession, d: str) -> DataFrame:
    return st.lww_latest(vw.reading_changes(spark, d), ["user_id", "item_id"])


# ------------------------------------------------------------ the read side

query("edition_counts", S(f"""
, r AS (SELECT s.*, coalesce(rd.read, false) AS is_read, coalesce(rd.saved, false) AS is_saved, coalesce(rd.later, false) AS is_later FROM stories s LEFT JOIN reading rd ON rd.user_id = s.user_id AND rd.item_id = s.id)
SELECT user_id, 'all' AS scope, NULL::VARCHAR AS name, count(*) FILTER (NOT is_read) AS n FROM r GROUP BY user_id
UNION ALL SELECT user_id, 'today', NULL, count(*) FILTER (NOT is_read AND minutes_ago < 1440) FROM r GROUP BY user_id
UNION ALL SELECT user_id, 'saved', NULL, count(*) FILTER (is_saved) FROM r GROUP BY user_id
UNION ALL SELECT user_id, 'later', NULL, count(*) FILTER (is_later) FROM r GROUP BY user_id
UNION ALL SELECT user_id, 'feed', feed_id, count(*) FILTER (NOT is_read) FROM r GROUP BY user_id, feed_id
UNION ALL SELECT u.user_id, 'folder', f.name, count(r.id) FILTER (NOT r.is_read) FROM (SELECT DISTINCT user_id FROM r) u CROSS JOIN (VALUES {", ".join(f"('{x}')" for x in fixed.FOLDERS)}) f(name)
  LEFT JOIN r ON r.user_id = u.user_id AND r.folder = f.name GROUP BY u.user_id, f.name""", "reading"))(lambda s, d: so.edition_counts(_stories(s, d), _reading(s, d)))  # fmt: skip

query("store_load", W("SELECT 'sources' AS store, count(*) AS n FROM sources WHERE deleted_at IS NULL UNION ALL SELECT 'classifications', count(*) FROM classifications WHERE deleted_at IS NULL UNION ALL SELECT 'articles', count(*) FROM articles UNION ALL SELECT 'reading', count(*) FROM reading UNION ALL SELECT 'topics', count(*) FROM topics", "sources", "articles", "classifications", "reading", "topics"))(
    lambda s, d: wl.store_counts({"sources": vw.sources(s, d), "classifications": vw.classifications(s, d), "articles": vw.articles(s, d).drop("body"), "reading": _reading(s, d), "topics": vw.topics(s, d)})
)
query("articles_of_source", W("SELECT id, title FROM articles WHERE source_id = 'src3'", "articles"))(lambda s, d: ArticleStore.create(vw.articles(s, d).drop("body")).of_source("src3").select("id", "title"))
query("story_shape", W(f"SELECT a.id, {_MIN} AS minutes_ago, strftime(a.published_at, '%-d %B %Y') AS published_label, CASE WHEN content_state = 'summary' THEN 'summary' WHEN summary <> '' AND trim(regexp_replace(list_aggregate(paragraphs, 'string_agg', ' '), '\\s+', ' ', 'g'), ' ') = summary THEN 'summary' ELSE 'full' END AS content_state FROM articles a", "articles"))(
    lambda s, d: so.shape_stories(vw.articles(s, d), vw.now()).select("id", "minutes_ago", "published_label", "content_state")
)
query("feed_shape", W("SELECT id AS feed_id, title AS name, 'S' || left(split_part(title, ' ', 2), 1) AS mark, folder FROM sources WHERE deleted_at IS NULL", "sources"))(lambda s, d: so.shape_feeds(vw.sources(s, d)).select("feed_id", "name", "mark", "folder"))
query("stories", S("SELECT s.user_id, s.id, coalesce(c.topic_ids, []) AS topics, c.status AS classification_status FROM stories s LEFT JOIN classifications c ON c.user_id = s.user_id AND c.item_id = s.id AND c.deleted_at IS NULL", "classifications"))(
    lambda s, d: so.classified(_stories(s, d), vw.classifications(s, d)).select("user_id", "id", "topics", "classification_status")
)
query("stories_with_feed", S("SELECT user_id, id, feed_name, folder, host FROM stories"))(lambda s, d: _stories(s, d).select("user_id", "id", "feed_name", "folder", "host"))
for _flag in ("saved", "later"):
    query(f"{_flag}_stories", S(f"SELECT s.user_id, s.id FROM stories s JOIN reading r ON r.user_id = s.user_id AND r.item_id = s.id AND r.{_flag}", "reading"))(
        lambda s, d, flag=_flag: so.flagged(_stories(s, d), _reading(s, d), flag).select("user_id", "id")
    )
query("unread_stories", S("SELECT user_id, id FROM stories s WHERE NOT EXISTS (SELECT 1 FROM reading r WHERE r.user_id = s.user_id AND r.item_id = s.id AND r.read)", "reading"))(lambda s, d: so.unread(_stories(s, d), _reading(s, d)).select("user_id", "id"))
_VIEWS = ["today", "saved", "later", "folder:science", "feed:src1", "all"]
query("view_filter", S("""SELECT user_id, id, 'today' AS view FROM stories WHERE minutes_ago < 1440 UNION ALL SELECT user_id, id, 'folder:science' FROM stories WHERE folder = 'science'
 UNION ALL SELECT user_id, id, 'feed:src1' FROM stories WHERE feed_id = 'src1' UNION ALL SELECT user_id, id, 'all' FROM stories
 UNION ALL SELECT s.user_id, s.id, 'saved' FROM stories s JOIN reading r ON r.user_id = s.user_id AND r.item_id = s.id AND r.saved
 UNION ALL SELECT s.user_id, s.id, 'later' FROM stories s JOIN reading r ON r.user_id = s.user_id AND r.item_id = s.id AND r.later""", "reading"))(
    lambda s, d: wl.union_all([so.view_filter(_stories(s, d), v, _reading(s, d)).select("user_id", "id", F.lit(v).alias("view")) for v in _VIEWS])
)
query("story_search", S("SELECT user_id, id FROM stories WHERE contains(lower(title), 'the an') OR contains(lower(dek), 'the an') OR contains(lower(feed_name), 'the an')"))(lambda s, d: so.search(_stories(s, d), " The AN ").select("user_id", "id"))
query("palette_search", S("SELECT user_id, id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY minutes_ago, id) AS rank FROM stories WHERE contains(lower(title), 'author 3') OR contains(lower(dek), 'author 3') OR contains(lower(feed_name), 'author 3') OR contains(lower(byline), 'author 3')) WHERE rank <= 24"))(
    lambda s, d: so.palette_search(_stories(s, d), "Author 3").select("user_id", "id", "rank")
)
def _searched(spark, d, text: str, byline: bool) -> DataFrame:
    """A search by an index that got the articles in two batches."""
    index = TrigramIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    articles = vw.articles(spark, d).select("id", "title", "summary", "author")
    for i in (0, 1):
        index.add(articles.where(F.pmod(F.xxhash64("id"), F.lit(2)) == i), i)
    return index.search(_stories(spark, d), text, byline)


query("story_search_indexed", ORACLES["story_search"])(lambda s, d: _searched(s, d, " The AN ", False).select("user_id", "id"))
query("palette_search_indexed", ORACLES["palette_search"])(lambda s, d: so.newest(_searched(s, d, "Author 3", True), 24).select("user_id", "id", "rank"))
query("palette_recent", S("SELECT user_id, id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY minutes_ago, id) AS rank FROM stories) WHERE rank <= 7"))(lambda s, d: so.palette_search(_stories(s, d), "  ").select("user_id", "id", "rank"))
query("topic_filter", S("SELECT s.user_id, s.id FROM stories s JOIN classifications c ON c.user_id = s.user_id AND c.item_id = s.id AND c.deleted_at IS NULL WHERE list_contains(c.topic_ids, 'ai')", "classifications"))(lambda s, d: so.topic_filter(so.classified(_stories(s, d), vw.classifications(s, d)), "ai").select("user_id", "id"))
query("topic_counts", S("SELECT user_id, topic_id, count(*) AS n FROM (SELECT s.user_id, unnest(c.topic_ids) AS topic_id FROM stories s JOIN classifications c ON c.user_id = s.user_id AND c.item_id = s.id AND c.deleted_at IS NULL) GROUP BY ALL", "classifications"))(lambda s, d: so.topic_counts(so.classified(_stories(s, d), vw.classifications(s, d))))
query("today_totals", S("SELECT user_id, count(*) AS stories, sum(minutes)::BIGINT AS minutes FROM stories WHERE minutes_ago < 1440 GROUP BY user_id"))(lambda s, d: so.today_totals(_stories(s, d)))
query("column_stats", S("SELECT user_id, count(*) AS stories, sum(minutes)::BIGINT AS minutes, count(DISTINCT feed_id) AS sources FROM stories GROUP BY user_id"))(lambda s, d: so.column_stats(_stories(s, d)))
query("column_stats_merged", S("SELECT user_id, count(*) AS stories, sum(minutes)::BIGINT AS minutes, count(DISTINCT feed_id) AS sources FROM stories WHERE minutes_ago < 30240 GROUP BY user_id"))(lambda s, d: so.merged_stats(so.column_sketches(_stories(s, d)).where("day < 21")))
query("original_url", S("SELECT user_id, id, coalesce(link, site_url) AS original_url FROM stories"))(lambda s, d: so.original_url(_stories(s, d)).select("user_id", "id", "original_url"))
query("stream_order", S("SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY minutes_ago, id)::INT AS rank FROM stories"))(lambda s, d: so.stream_order(_stories(s, d)).select("user_id", "id", "rank"))
query("sources_order", W("SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY added_at DESC, id)::INT AS rank FROM sources WHERE deleted_at IS NULL", "sources"))(lambda s, d: so.sources_order(vw.sources(s, d)).select("user_id", "id", "rank"))
query("sweep_order", S("SELECT s.user_id, s.id, row_number() OVER (PARTITION BY s.user_id ORDER BY CASE WHEN s.id = o.item_id THEN 0 ELSE 1 END, minutes_ago, s.id)::INT AS rank FROM stories s LEFT JOIN (SELECT user_id, max(id) AS item_id FROM stories GROUP BY user_id) o ON o.user_id = s.user_id"))(
    lambda s, d: so.sweep_order(_stories(s, d), _stories(s, d).groupBy("user_id").agg(F.max("id").alias("item_id"))).select("user_id", "id", "rank")
)
query("up_next", S("""SELECT user_id, id, first_value(seen IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY minutes_ago, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_id,
 last_value(seen IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY minutes_ago, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_id
 FROM (SELECT s.*, CASE WHEN r.item_id IS NULL THEN s.id END AS seen FROM stories s LEFT JOIN reading r ON r.user_id = s.user_id AND r.item_id = s.id AND r.read)""", "reading"))(lambda s, d: so.up_next(_stories(s, d), _reading(s, d)))  # fmt: skip
query("folders_in_use", W("SELECT DISTINCT user_id, folder FROM sources WHERE folder IS NOT NULL AND deleted_at IS NULL", "sources"))(lambda s, d: so.folders_in_use(so.shape_feeds(vw.sources(s, d))))
query("feed_union", W("SELECT user_id, id AS feed_id FROM sources WHERE deleted_at IS NULL UNION ALL SELECT u.user_id, f.id FROM (SELECT DISTINCT user_id FROM reading_changes WHERE user_id NOT IN (SELECT user_id FROM sources WHERE deleted_at IS NULL)) u CROSS JOIN (SELECT id FROM sources WHERE user_id = 0 AND deleted_at IS NULL) f", "sources", "reading_changes"))(
    lambda s, d: so.feed_union(so.shape_feeds(vw.sources(s, d)).select("user_id", "feed_id"), so.shape_feeds(vw.sources(s, d)).where("user_id = 0").select("feed_id"), vw.reading_changes(s, d))
)

# ---------------------------------------------------------- state and sync

query("lww_latest", W("SELECT * FROM reading", "reading"))(_reading)


def _removals(spark, d) -> DataFrame:
    """A changelog of items with days for times, so that many are equally old, and some that are deletions."""
    c = vw.reading_changes(spark, d)
    day = F.date_trunc("DAY", "updated_at")
    return c.select("item_id", day.alias("updated_at"), F.when(F.col("saved"), day).alias("deleted_at"), "seq")


query("lww_deletions", W("SELECT item_id, seq, deleted FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY day DESC, deleted DESC, seq) AS rn FROM (SELECT item_id, seq, date_trunc('day', updated_at) AS day, saved AS deleted FROM reading_changes)) WHERE rn = 1", "reading_changes"))(
    lambda s, d: st.lww_latest(_removals(s, d), ["item_id"], "deletion").select("item_id", "seq", F.col("deleted_at").isNotNull().alias("deleted"))
)
query("reading_flags", W("SELECT user_id, item_id, 'read' AS flag FROM reading WHERE read UNION ALL SELECT user_id, item_id, 'saved' FROM reading WHERE saved UNION ALL SELECT user_id, item_id, 'later' FROM reading WHERE later", "reading"))(lambda s, d: st.reading_flags(_reading(s, d)))


def _half(spark, d, odd: bool) -> DataFrame:
    """The state as of the first or second half of the changelog."""
    return st.lww_latest(vw.reading_changes(spark, d).where(F.col("seq") % 2 == int(odd)), ["user_id", "item_id"])


_HALF = "(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY updated_at DESC, seq DESC) AS rn FROM reading_changes WHERE seq % 2 = {}) WHERE rn = 1)"
query("changeset_merge", W(f"SELECT coalesce(b.user_id, a.user_id) AS user_id, coalesce(b.item_id, a.item_id) AS item_id, CASE WHEN a.item_id IS NULL OR b.updated_at >= a.updated_at THEN b.seq ELSE a.seq END AS seq FROM {_HALF.format(0)} a FULL JOIN {_HALF.format(1)} b ON a.user_id = b.user_id AND a.item_id = b.item_id", "reading_changes"))(
    lambda s, d: st.merge(_half(s, d, False), _half(s, d, True), ["user_id", "item_id"], "last").select("user_id", "item_id", "seq")
)
query("changes_since", W(f"SELECT 'sources' AS store, user_id || '/' || id AS key, updated_at, deleted_at IS NOT NULL AS deleted FROM sources WHERE updated_at > {NOW} - INTERVAL 100 MINUTE UNION ALL SELECT 'reading', user_id || '/' || item_id, updated_at, false FROM reading WHERE updated_at > {NOW} - INTERVAL 3000 MINUTE AND updated_at > {NOW} - INTERVAL 100 MINUTE UNION ALL SELECT 'classifications', user_id || '/' || item_id, updated_at, deleted_at IS NOT NULL FROM classifications WHERE updated_at > {NOW} - INTERVAL 100 MINUTE UNION ALL SELECT 'topics', user_id || '/' || id, {NOW}, false FROM topics", "sources", "reading", "classifications", "topics"))(
    lambda s, d: st.changes_since(
        {"sources": vw.sources(s, d), "reading": _reading(s, d), "classifications": vw.classifications(s, d), "topics": vw.topics(s, d)},
        vw.minutes_before(vw.now(), F.lit(100)),
        {"sources": ["user_id", "id"], "reading": ["user_id", "item_id"], "classifications": ["user_id", "item_id"], "topics": ["user_id", "id"]},
    ).drop("row")
)
query("store_upsert", W(f"SELECT user_id, item_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY fresh DESC, seq DESC) AS rn FROM (SELECT *, 0 AS fresh FROM {_HALF.format(0)} UNION ALL SELECT *, 1 FROM reading_changes WHERE seq % 2 = 1)) WHERE rn = 1", "reading_changes"))(
    lambda s, d: st.upsert(_half(s, d, False), vw.reading_changes(s, d).where("seq % 2 = 1").withColumn("position", F.col("seq")), ["user_id", "item_id"]).select("user_id", "item_id", "seq")
)
query("tombstone", W(f"SELECT user_id, item_id, CASE WHEN doc_id % 3 = 0 THEN {NOW} ELSE deleted_at END AS deleted_at, CASE WHEN doc_id % 3 = 0 THEN {NOW} ELSE updated_at END AS updated_at FROM classifications", "classifications"))(
    lambda s, d: st.tombstone(vw.classifications(s, d), vw.classifications(s, d).where(F.substring_index("item_id", "~", -1).cast("long") % 3 == 0), ["user_id", "item_id"], vw.now()).select("user_id", "item_id", "deleted_at", "updated_at")
)
query("reading_patch", W(f"SELECT a.user_id, a.item_id, CASE WHEN a.action = 'mark_read' THEN true ELSE coalesce(r.read, false) END AS read, CASE WHEN a.action = 'toggle_saved' THEN NOT coalesce(r.saved, false) ELSE coalesce(r.saved, false) END AS saved, coalesce(r.later, false) AS later FROM (SELECT user_id, item_id, CASE WHEN max(seq) % 2 = 0 THEN 'mark_read' ELSE 'toggle_saved' END AS action FROM reading_changes GROUP BY ALL) a LEFT JOIN {_HALF.format(0)} r ON r.user_id = a.user_id AND r.item_id = a.item_id WHERE a.action <> 'mark_read' OR NOT coalesce(r.read, false)", "reading_changes"))(
    lambda s, d: st.reading_patch(_half(s, d, False), vw.reading_changes(s, d).groupBy("user_id", "item_id").agg(F.when(F.max("seq") % 2 == 0, "mark_read").otherwise("toggle_saved").alias("action")), vw.now()).drop("updated_at")
)


def _doc(c: str = "id"):
    return F.substring_index(c, "~", -1).cast("long")


def _replaced(spark, d) -> DataFrame:
    """The stored articles after three sources were refreshed in place."""
    articles = vw.articles(spark, d).drop("body")
    refreshed = F.col("source_id").isin("src1", "src2", "src3")
    store = ArticleStore.create(articles)
    store.replace(articles.where(refreshed & (_doc() % 2 == 0)), articles.where(refreshed).select("source_id").distinct(), articles.where(_doc() % 7 == 3).select("id"))
    return store.rows()


query("cache_replace", W("SELECT id FROM articles WHERE source_id NOT IN ('src1', 'src2', 'src3') OR doc_id % 2 = 0 OR doc_id % 7 = 3", "articles"))(lambda s, d: _replaced(s, d).select("id"))
query("source_remove", W("SELECT id FROM articles WHERE source_id NOT IN (SELECT id FROM sources WHERE user_id = 1)", "articles", "sources"))(
    lambda s, d: st.remove_source(vw.sources(s, d), vw.articles(s, d), vw.sources(s, d).where("user_id = 1").select("user_id", "id"), vw.now())[1].select("id")
)
query("item_cap", W("SELECT source_id, id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY doc_id) AS rn FROM articles) WHERE rn <= 20", "articles"))(lambda s, d: st.item_cap(vw.articles(s, d).withColumn("pos", _doc()), fixed.SOURCE_ITEMS).select("source_id", "id"))

# ---------------------------------------------------------------- refreshing

query("sources_stale", W(f"SELECT user_id, id FROM sources WHERE deleted_at IS NULL AND fetched_at <= {NOW} - INTERVAL 30 MINUTE", "sources"))(lambda s, d: rf.sources_stale(vw.sources(s, d), vw.now()).select("user_id", "id"))
query("sources_stale_order", W(f"SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY fetched_at, id)::INT AS rank FROM (SELECT * FROM sources WHERE deleted_at IS NULL AND fetched_at <= {NOW} - INTERVAL 30 MINUTE AND (substr(id, 4)::INT % 4 > 1 OR {NOW} - to_minutes(substr(id, 4)::INT * 3) <= {NOW} - INTERVAL 30 MINUTE))", "sources"))(
    lambda s, d: rf.sweep(rf.sources_stale(vw.sources(s, d), vw.now(), _attempts(s, d))).select("user_id", "id", "rank")
)
query("sources_forced", W("SELECT user_id, id FROM sources WHERE deleted_at IS NULL", "sources"))(lambda s, d: rf.sources_stale(vw.sources(s, d), vw.now(), _attempts(s, d), forced=True).select("user_id", "id"))


def _attempts(spark, d) -> DataFrame:
    """Attempts at half of the sources, some of them less than half an hour ago."""
    n = F.substring("id", 4, 9).cast("int")
    return vw.sources(spark, d).where(n % 4 <= 1).select("user_id", "id", vw.minutes_before(vw.now(), n * 3).alias("attempted_at"))


query("article_refresh_due", W(f"""SELECT id, CASE WHEN link IS NULL THEN false WHEN extractor_version <> 12 THEN true WHEN extraction_state = 'failed' AND {NOW} - coalesce(content_checked_at, TIMESTAMP '1970-01-01') < INTERVAL 12 HOUR THEN false
 WHEN content_fetched_at IS NOT NULL THEN {NOW} - content_checked_at >= INTERVAL 6 HOUR ELSE true END AS due FROM articles""", "articles"))(lambda s, d: vw.articles(s, d).select("id", rf.article_refresh_due(vw.now()).alias("due")))  # fmt: skip
_RECON = f"""inc AS (SELECT *, CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'New ' || summary END AS new_summary FROM articles WHERE doc_id % 6 <> 5)
SELECT i.id, CASE WHEN e.extraction_state = 'success' AND i.new_summary = '' THEN e.summary ELSE i.new_summary END AS summary, CASE WHEN e.extraction_state = 'success' THEN 'success' WHEN e.extraction_state = 'failed' AND i.content_state <> 'full' THEN 'failed' ELSE 'idle' END AS extraction_state,
 e.extraction_state IS DISTINCT FROM 'success' AS rebuilt FROM inc i LEFT JOIN articles e ON e.id = i.id AND e.doc_id % 10 <> 7"""


def _incoming(spark, d) -> DataFrame:
    """Feed items made of the articles, some with other summaries, some missing."""
    a = vw.articles(spark, d).where(_doc() % 6 != 5)
    fresh = F.when(_doc() % 9 == 0, "").otherwise(F.concat(F.lit("New "), "summary"))
    return a.withColumn("summary", fresh).withColumn("id", _doc().cast("string")).select("source_id", "id", "title", "link", "author", "published_at", "summary", "body", "image", "has_cover", "image_caption", "content_state", "minutes", "layout")


def _cached(spark, d) -> DataFrame:
    return vw.articles(spark, d).where(_doc() % 10 != 7)


query("feed_reconcile", W("", "articles").rstrip() + ",\n" + _RECON)(lambda s, d: rf.reconcile(_incoming(s, d), _cached(s, d), vw.now()).select("id", "summary", "extraction_state", "rebuilt"))


def _again(spark, d) -> tuple[DataFrame, DataFrame]:
    """Items of a second refresh, and the articles that the first one left: of each three sources one has other titles, one has lost items, one is as it was."""
    n = F.substring("source_id", 4, 9).cast("int") % 3
    first = vw.articles(spark, d).withColumn("id", _doc().cast("string")).select("source_id", "id", "title", "link", "author", "published_at", "summary", "body", "image", "has_cover", "image_caption", "content_state", "minutes", "layout")
    cached = rf.reconcile(first, vw.articles(spark, d), vw.minutes_before(vw.now(), F.lit(60))).drop("rebuilt")
    k = F.col("id").cast("long")
    second = first.where((n != 1) | (k % 50 != 7)).withColumn("title", F.when((n == 0) & (k % 40 == 2), F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    return second, cached


#: An article whose page was read keeps its title, so a new title there changes nothing.
_CHANGED = "SELECT source_id, bool_or(substr(source_id, 4)::INT % 3 = 0 AND doc_id % 40 = 2 AND doc_id % 3 <> 0 OR substr(source_id, 4)::INT % 3 = 1 AND doc_id % 50 = 7) AS changed FROM articles GROUP BY source_id"
query("feed_changed", W(_CHANGED, "articles"))(lambda s, d: rf.refresh_changes(*_again(s, d), vw.now())[1])
query("feed_changes", W(f"changed AS ({_CHANGED}) SELECT a.id, CASE WHEN substr(source_id, 4)::INT % 3 = 0 AND doc_id % 40 = 2 AND doc_id % 3 <> 0 THEN title || '!' ELSE title END AS title, len(paragraphs)::INT AS blocks FROM articles a JOIN changed c USING (source_id) WHERE changed AND (substr(source_id, 4)::INT % 3 <> 1 OR doc_id % 50 <> 7)", "articles").replace(")\nchanged AS", "),\nchanged AS"))(
    lambda s, d: rf.refresh_changes(*_again(s, d), vw.now())[0].select("id", "title", F.size("body").alias("blocks"))
)
query("source_edit", W("SELECT id, CASE WHEN user_id = 1 THEN 'Renamed' ELSE title END AS title, CASE WHEN user_id = 2 THEN NULL ELSE folder END AS folder, CASE WHEN user_id = 3 THEN 'other.example' ELSE host END AS host FROM sources", "sources"))(
    lambda s, d: rf.source_edit(
        vw.sources(s, d),
        vw.sources(s, d).where("user_id > 0").select("user_id", "id", F.when(F.col("user_id") == 1, " Renamed ").otherwise(" ").alias("title"), F.lit(None).cast("string").alias("folder"), (F.col("user_id") == 2).alias("unfile"), F.when(F.col("user_id") == 3, "https://www.other.example/x").alias("url")),
        vw.now(),
    ).select("id", "title", "folder", "host")
)
query("source_refresh_log", W(f"SELECT id, CASE WHEN user_id = 1 THEN {NOW} ELSE fetched_at END AS fetched_at, CASE WHEN user_id = 2 THEN 'gone' END AS error, CASE WHEN user_id IN (1, 2) THEN {NOW} ELSE updated_at END AS updated_at, CASE WHEN user_id = 1 THEN 'new.example' ELSE host END AS host FROM sources", "sources"))(
    lambda s, d: rf.source_refresh_log(
        vw.sources(s, d),
        vw.sources(s, d).where("user_id IN (1, 2)").select("user_id", "id", (F.col("user_id") == 1).alias("ok"), F.lit("https://new.example/").alias("site_url"), F.when(F.col("user_id") == 2, "gone").alias("error")),
        vw.now(),
    ).select("id", "fetched_at", "error", "updated_at", "host")
)
query("source_subscribe", W("SELECT source_id || '~' || doc_id AS id, 'idle' AS extraction_state FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY doc_id) AS rn FROM articles) WHERE rn <= 20", "articles"))(
    lambda s, d: wl.subscribe(_with_pos(vw.articles(s, d)), vw.articles(s, d), vw.now()).select("id", "extraction_state")
)


def _with_pos(articles: DataFrame) -> DataFrame:
    return articles.withColumn("pos", _doc()).withColumn("id", _doc().cast("string"))


query("page_update")(lambda s, d: wl.page_update(vw.articles(s, d), vw.table(s, d, "pages").withColumn("url", F.format_string("https://src%s.example/%s", (F.col("page_id") % 20).cast("string"), F.col("page_id").cast("string"))), vw.now()).groupBy("extraction_state", "content_state").agg(F.count(F.lit(1)).alias("n"), F.sum("minutes").alias("minutes")))


def _outcomes(spark, d) -> DataFrame:
    """What became of the pages of the articles with links: read, unchanged, failed, or never asked for."""
    k = _doc()
    a = vw.articles(spark, d).where(F.col("link").isNotNull() & (k % 4 < 3))
    return a.select(
        "link",
        F.when(k % 4 == 0, "ok").when(k % 4 == 1, "not_modified").otherwise("failed").alias("outcome"),
        F.when(k % 8 == 0, F.concat(F.lit("Page of "), "title")).otherwise("").alias("title"),
        F.when(k % 16 == 0, "Someone").alias("author"),
        F.slice("body", 1, 1).alias("body"),
        (k % 12 == 0).alias("truncated"),
        F.when(k % 20 == 0, "https://x.example/p.jpg").alias("image"),
        F.when(k % 20 == 0, True).alias("has_cover"),
        F.lit(None).cast("boolean").alias("video_page"),
        F.when(k % 24 == 0, "e1").alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
    )


query("extraction_apply", W(f"""asked AS (SELECT *, CASE WHEN link IS NULL THEN 3 ELSE doc_id % 4 END AS k, content_fetched_at IS NOT NULL OR extraction_state = 'success' AS original FROM articles)
 SELECT id, CASE WHEN k = 0 AND doc_id % 8 = 0 THEN 'Page of ' || title ELSE title END AS title, CASE WHEN k = 0 AND doc_id % 16 = 0 THEN 'Someone' ELSE author END AS author,
 (CASE WHEN k = 0 THEN least(1, len(paragraphs)) ELSE len(paragraphs) END)::INT AS blocks, CASE WHEN k = 0 AND doc_id % 20 = 0 THEN 'https://x.example/p.jpg' END AS image, CASE WHEN k = 0 AND doc_id % 24 = 0 THEN 'e1' END AS etag,
 CASE WHEN k = 0 THEN greatest(1, floor(len(regexp_extract_all(coalesce(paragraphs[1], ''), '\\S+')) / 225.0::DOUBLE + 0.5))::INT ELSE minutes END AS minutes, CASE WHEN k = 0 THEN CASE WHEN doc_id % 12 = 0 THEN 'truncated' ELSE 'full' END ELSE content_state END AS content_state,
 CASE WHEN k = 0 THEN 'success' WHEN k = 2 AND NOT original THEN 'failed' ELSE extraction_state END AS extraction_state, CASE WHEN k = 0 THEN {NOW} ELSE content_fetched_at END AS content_fetched_at, CASE WHEN k < 3 THEN {NOW} ELSE content_checked_at END AS content_checked_at,
 CASE WHEN k IN (0, 2) THEN 12 ELSE extractor_version END AS extractor_version FROM asked""", "articles").replace(")\nasked AS", "),\nasked AS"))(
    lambda s, d: rf.apply_extraction(vw.articles(s, d), _outcomes(s, d), vw.now()).select("id", "title", "author", F.size("body").alias("blocks"), "image", "etag", "minutes", "content_state", "extraction_state", "content_fetched_at", "content_checked_at", "extractor_version")
)
query("folder_suggest", W("SELECT id, coalesce(folder, CASE WHEN substr(id, 4)::INT % 5 >= 2 THEN 'ideas' END) AS folder FROM sources", "sources"))(
    lambda s, d: rf.folder_suggest(vw.sources(s, d), vw.sources(s, d).select("user_id", "id", F.lit("ideas").alias("slug"), (0.4 + F.substring("id", 4, 9).cast("int") % 5 * 0.1).alias("confidence"))).select("id", "folder")
)

# --------------------------------------------------------------------- feeds

#: Feeds of each source and their entries; the 40 first of a feed count.
_FEEDS = W("", "sources", "articles").rstrip() + """,
feeds AS (SELECT s.id AS source_id, s.title AS feed_title, s.site_url, substr(s.id, 4)::INT % 3 AS kind, a.doc_id // 800 AS part, s.site_url || 'feed-' || (a.doc_id // 800) || '.xml' AS feed_url, least(40, count(*))::INT AS n_items FROM sources s JOIN articles a ON a.source_id = s.id GROUP BY ALL),
entries AS (SELECT *, site_url || doc_id AS url FROM (SELECT f.feed_url, f.site_url, f.kind, f.n_items, d.doc_id, d.text, row_number() OVER (PARTITION BY f.feed_url ORDER BY d.doc_id) AS rn FROM feeds f JOIN documents d ON d.source = f.source_id AND d.doc_id // 800 = f.part) WHERE rn <= 40)
"""
_KIND = "CASE kind WHEN 0 THEN 'rss' WHEN 1 THEN 'atom' ELSE 'rdf' END"
query("feed_parse", _FEEDS + f"SELECT feed_url, {_KIND} AS kind, feed_title AS title, site_url, n_items FROM feeds")(lambda s, d: fd.parse(vw.feed_documents(s, d)).select("feed_url", "kind", "title", "site_url", F.size("items").alias("n_items")))
query("feed_meta", _FEEDS + "SELECT feed_url, feed_title AS title, site_url, CASE WHEN kind = 2 THEN '' ELSE 'About it' END AS description, CASE WHEN kind = 1 THEN 'Desk' ELSE '' END AS channel_author FROM feeds")(lambda s, d: fd.parse(vw.feed_documents(s, d)).select("feed_url", "title", "site_url", "description", "channel_author"))
query("feed_kind", _FEEDS + f"SELECT feed_url, {_KIND} AS kind FROM feeds")(lambda s, d: vw.feed_documents(s, d).select("feed_url", fd.feed_kind(F.col("body")).alias("kind")))
_TYPES = ["text/html", "application/xml", "application/json", "text/plain"]
query("feed_sniff", rf"""SELECT page_id, CASE WHEN regexp_matches(head, '^\s*\{{') THEN contains(kind, 'json') ELSE contains(kind, 'xml') OR regexp_matches(head, '(?i)^\s*<\?xml') OR regexp_matches(head, '(?i)<(rss|feed|rdf:RDF)\b') END AS is_feed
 FROM (SELECT page_id, left(CASE page_id % 3 WHEN 0 THEN '<?xml version="1.0"?>' WHEN 1 THEN '{{"x":1}}' ELSE '' END || html, 900) AS head, {_TYPES}[1 + page_id // 3 % 4] AS kind FROM pages)""")(
    lambda s, d: vw.table(s, d, "pages").select("page_id", urls.looks_like_feed(F.concat(F.when(F.col("page_id") % 3 == 0, '<?xml version="1.0"?>').when(F.col("page_id") % 3 == 1, '{"x":1}').otherwise(""), "html"), F.get(F.array(*map(F.lit, _TYPES)), (F.floor(F.col("page_id") / 3) % 4).cast("int"))).alias("is_feed"))
)
query("feed_items", _FEEDS + """, named AS (SELECT *, CASE kind WHEN 1 THEN 'urn:' || doc_id WHEN 0 THEN doc_id::VARCHAR ELSE url END AS k FROM entries), hashed AS (SELECT *, """ + _FNV.format("k") + """ AS h FROM named)
SELECT feed_url, url AS link, (rn - 1)::INT AS pos, lower(to_base(CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END, 36)) AS id, CASE kind WHEN 0 THEN 'A ' || (doc_id % 7) WHEN 1 THEN 'Desk' END AS author, TIMESTAMP '2024-01-01' AS published_at, NULL::VARCHAR AS image, false AS has_cover FROM hashed""")(
    lambda s, d: fd.items(fd.parse(vw.feed_documents(s, d))).select("feed_url", "link", "pos", "id", "author", "published_at", "image", "has_cover")
)
query("item_valid", _FEEDS + "SELECT feed_url, count(*) AS n FROM entries WHERE doc_id % 5 <> 0 GROUP BY feed_url")(lambda s, d: fd.items(fd.parse(vw.feed_documents(s, d, 5))).groupBy("feed_url").agg(F.count(F.lit(1)).alias("n")))
_LOOSE = _FEEDS + """, crcs AS (SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(feed_url, ''), lambda c: unicode(c)::BIGINT), lambda h, b: list_reduce([xor(h, b)] || range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 7 = 0 AS cut FROM feeds)
"""
query("feed_loose", _LOOSE + r"""SELECT e.feed_url, (rn - 1)::INT AS pos, url AS link, trim(regexp_replace(left(split_part(coalesce(text, ''), chr(10), 1), 60) || ' x & y — bold 1 < 2', '[ \t]+', ' ', 'g'), ' ') || chr(10) || 'end' AS title FROM entries e JOIN crcs c ON c.feed_url = e.feed_url WHERE NOT cut""")(
    lambda s, d: fd.items(fd.parse(vw.loose_feed_documents(s, d))).select("feed_url", "pos", "link", "title")
)
query("feed_errors", _LOOSE + "SELECT feed_url, 'not valid XML' AS error FROM crcs WHERE cut")(lambda s, d: fd.errors(fd.parse(vw.loose_feed_documents(s, d))))
query("feed_preview", _FEEDS + "SELECT feed_url, url AS link, rn::INT AS rank, n_items::BIGINT AS n_items FROM entries WHERE rn <= 5")(lambda s, d: fd.preview(fd.items(fd.parse(vw.feed_documents(s, d)))).select("feed_url", "link", "rank", "n_items"))
_PITCH = "This is the letter that comes every week, to all of our readers. "
query("shared_opening", W(f"""SELECT source_id, CASE WHEN n >= 3 AND length(trim(cut, ' ')) >= 60 THEN cut ELSE '' END AS opening FROM (
 SELECT source_id, n, CASE WHEN ends <> '' THEN ends ELSE prefix END AS cut FROM (SELECT *, regexp_extract(prefix, '(?s)^(.*[.!?;]) ', 1) AS ends FROM (
 SELECT source_id, n, left(low, len(list_filter(range(1, least(length(low), length(high)) + 1), lambda i: left(low, i) = left(high, i)))) AS prefix FROM (
 SELECT source_id, min(t) AS low, max(t) AS high, count(*) AS n FROM (SELECT source_id, '{_PITCH}' || summary AS t FROM articles) GROUP BY source_id))))""", "articles"))(
    lambda s, d: fd.shared_openings(vw.articles(s, d).select("source_id", F.concat(F.lit(_PITCH), "summary").alias("summary")), "source_id")
)


def _linked(pages: DataFrame) -> DataFrame:
    """The pages with links to two feeds, one of them twice, and to a style sheet."""
    k, i = (F.col("page_id") % 3).cast("string"), F.col("page_id").cast("string")
    feed = F.concat(F.lit('<link rel="alternate" type="application/rss+xml" href="/feed-'), k, F.lit('" title="T'), i, F.lit('">'))
    other = F.lit("<link type='application/atom+xml' href='../x/./atom.xml'><link rel=\"stylesheet\" type=\"text/css\" href=\"/x.css\">")
    return pages.withColumn("html", F.concat(feed, other, feed, "html"))


query("feed_discover", r"""SELECT url, 1 AS rank, origin || '/feed-' || (page_id % 3) AS href, 'T' || page_id AS title FROM (SELECT *, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin FROM pages)
 UNION ALL SELECT url, 2, origin || coalesce('/' || nullif(array_to_string(folders[:len(folders) - 1], '/'), ''), '') || '/x/atom.xml', '' FROM (
 SELECT *, list_filter(string_split(regexp_extract(substr(url, length(origin) + 1), '^/(.*/)?[^/]*$', 1), '/'), lambda x: x <> '') AS folders FROM (SELECT *, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin FROM pages))""")(lambda s, d: fd.discover(_linked(vw.table(s, d, "pages"))))
query("best_link", _FEEDS + "SELECT feed_url, (rn - 1)::INT AS pos, url AS link FROM entries")(lambda s, d: fd.parse(vw.feed_documents(s, d)).select("feed_url", F.posexplode("items").alias("pos", "x"), "site_url").select("feed_url", "pos", fd.best_link(F.col("x.link"), F.col("site_url")).alias("link")))
query("size_cap", "SELECT page_id, strlen(html) <= 20000 AS fits FROM pages")(lambda s, d: vw.table(s, d, "pages").select("page_id", pg.within_size(F.col("html"), 20_000).alias("fits")))

# --------------------------------------------------------------------- pages

query("page_read", "SELECT url, strlen(html) AS bytes FROM pages WHERE html ILIKE '%<html%'")(lambda s, d: pg.html_pages(vw.table(s, d, "pages")).select("url", F.octet_length("html").cast("long").alias("bytes")))
query("page_extract")(lambda s, d: pg.extract(vw.table(s, d, "pages")).select("url", "error", "title", "truncated", "text_length", F.size("body").alias("blocks")))
query("extraction_stats")(lambda s, d: pg.extraction_stats(pg.extract(vw.table(s, d, "pages"))))
query("html_blocks")(lambda s, d: vw.table(s, d, "pages").select("page_id", hx.html_blocks(F.col("html"), F.col("url"), fixed.ARTICLE_BUDGET).alias("b")).select("page_id", F.size("b.blocks").alias("blocks"), "b.truncated", bl.blocks_to_text(F.col("b.blocks")).alias("text")))
query("page_meta", r"""SELECT url, nullif(regexp_extract(regexp_extract(html, '(?i)<meta\b[^>]*(?:property|name)=["'']description["''][^>]*>', 0), '(?i)\bcontent=["'']([^"'']*)["'']', 1), '') AS description FROM pages""")(lambda s, d: vw.table(s, d, "pages").select("url", pg.page_meta(F.col("html"), "description").alias("description")))
query("video_embed")(lambda s, d: vw.table(s, d, "pages").select("url", hx.read_page(F.col("html"), F.col("url")).alias("x")).select("url", F.col("x.video.provider").alias("provider"), F.col("x.video.video_id").alias("video_id")))
query("video_page")(lambda s, d: vw.table(s, d, "pages").select("url", hx.read_page(F.col("html"), F.col("url")).alias("x")).select("url", "x.video_page"))


def _bodies(spark, d):
    """Two extractions of each page: by region, and of the whole body."""
    pages = vw.table(spark, d, "pages")
    a = pg.extract(pages).select("url", "body")
    b = pages.select("url", hx.html_blocks(F.col("html"), F.col("url"), fixed.ARTICLE_BUDGET)["blocks"].alias("body"))
    return a, b


query("paragraph_diff")(lambda s, d: pg.paragraph_diff(*_bodies(s, d)))
query("paragraph_diff_counts")(lambda s, d: pg.paragraph_diff_counts(pg.paragraph_diff(*_bodies(s, d))))

# ------------------------------------------------------------ classification

def _known():
    return F.array(*[F.lit(t[0]) for t in fixed.TOPICS[:11]])

query("classification_due", S("SELECT s.user_id, s.id FROM stories s LEFT JOIN classifications c ON c.user_id = s.user_id AND c.item_id = s.id WHERE NOT coalesce(c.deleted_at IS NULL AND (c.status IN ('confirmed', 'rejected') OR c.doc_id % 3 = 0), false)", "classifications"))(
    lambda s, d: cl.due(_user_articles(s, d), _fingerprinted(s, d)).select("user_id", "id")
)
query("classification_backlog", S("SELECT s.user_id, count(*) AS pending FROM stories s LEFT JOIN classifications c ON c.user_id = s.user_id AND c.item_id = s.id WHERE NOT coalesce(c.deleted_at IS NULL AND (c.status IN ('confirmed', 'rejected') OR c.doc_id % 3 = 0), false) GROUP BY s.user_id", "classifications"))(
    lambda s, d: cl.due(_user_articles(s, d), _fingerprinted(s, d)).groupBy("user_id").agg(F.count(F.lit(1)).alias("pending"))
)


def _fingerprinted(spark, d) -> DataFrame:
    """The classifications, a third of them of their articles as they are now."""
    a = vw.articles(spark, d).select(F.col("id").alias("item_id"), tx.fingerprint(F.col("title"), F.col("summary")).alias("now"))
    c = vw.classifications(spark, d).join(a, "item_id")
    return c.withColumn("content_fingerprint", F.when(_doc("item_id") % 3 == 0, F.col("now")).otherwise(F.col("content_fingerprint"))).drop("now")


def _user_articles(spark, d) -> DataFrame:
    a = vw.articles(spark, d).select("id", "source_id", "title", "summary")
    return a.join(so.shape_feeds(vw.sources(spark, d)).select("user_id", F.col("feed_id").alias("source_id")), "source_id").select("user_id", "id", "title", "summary")


_SLUGS = "[" + ", ".join(f"'{t[0]}'" for t in fixed.TOPICS[:11]) + "]"
_T = "[" + ", ".join(f"'{t[0]}'" for t in fixed.TOPICS) + "]"
_DECIDED = f"""SELECT source || '~' || doc_id AS item_id, doc_id, {_T}[1 + doc_id % 12] AS choice, {_T}[1 + (doc_id + 3) % 12] AS other, (50 + doc_id % 40) / 100.0::DOUBLE AS p, (doc_id % 30) / 100.0::DOUBLE AS q,
 doc_id % 19 = 0 AS failed, doc_id % 17 = 0 OR doc_id % 12 = 11 AS outside FROM labels JOIN documents USING (doc_id) WHERE source IS NOT NULL"""
_MSG = "CASE doc_id % 4 WHEN 0 THEN 'no quota' WHEN 1 THEN 'refused' WHEN 2 THEN 'broken' ELSE 'denied' END"
query("decision_parse", f"""WITH x AS ({_DECIDED}) SELECT item_id, CASE WHEN failed THEN {_MSG} WHEN outside THEN 'choice outside the offered topics' END AS error, CASE WHEN NOT failed AND NOT outside THEN choice END AS primary_slug,
 CASE WHEN NOT failed AND NOT outside THEN p END AS confidence, CASE WHEN NOT failed AND NOT outside THEN [choice] || CASE WHEN q >= 0.12 AND list_contains({_SLUGS}, other) THEN [other] ELSE [] END END AS topic_slugs FROM x""")(
    lambda s, d: cl.parse(vw.decisions(s, d), _known()).select("item_id", "error", "primary_slug", "confidence", "topic_slugs")
)
query("decision_read", f"WITH x AS ({_DECIDED}) SELECT failed OR outside AS refused, count(*) AS n FROM x GROUP BY 1")(lambda s, d: cl.parse(vw.decisions(s, d), _known()).groupBy(F.col("error").isNotNull().alias("refused")).agg(F.count(F.lit(1)).alias("n")))
query("secondary_topics", f"WITH x AS ({_DECIDED}) SELECT item_id, CASE WHEN q >= 0.12 AND list_contains({_SLUGS}, other) THEN 1 ELSE 0 END AS others FROM x WHERE NOT failed AND NOT outside")(lambda s, d: cl.parse(vw.decisions(s, d), _known()).where("error IS NULL").select("item_id", (F.size("topic_slugs") - 1).alias("others")))


def _suggested(spark, d) -> DataFrame:
    users = vw.sources(spark, d).select("user_id", F.col("id").alias("source_id"))
    p = cl.parse(vw.decisions(spark, d), _known()).withColumn("source_id", F.substring_index("item_id", "~", 1))
    return p.join(users, "source_id").select("user_id", "item_id", "error", "primary_slug", "topic_slugs", "confidence", "model")


query("classification_resolve", W(f"""x AS ({_DECIDED}) SELECT s.user_id, item_id, t.id AS primary_topic_id, CASE WHEN t.id IS NOT NULL THEN CASE WHEN p >= 0.6 THEN 'auto' ELSE 'needs_review' END END AS status
 FROM x JOIN sources s ON s.id = split_part(item_id, '~', 1) LEFT JOIN topics t ON t.user_id = s.user_id AND t.slug = x.choice AND NOT failed AND NOT outside""", "sources", "topics").replace(")\nx AS", "),\nx AS"))(
    lambda s, d: cl.resolve(_suggested(s, d), vw.topics(s, d)).select("user_id", "item_id", "primary_topic_id", "status")
)
query("classification_merge", W("SELECT user_id, item_id, CASE WHEN deleted_at IS NULL AND status IN ('confirmed', 'rejected') THEN status ELSE 'auto' END AS status FROM classifications", "classifications"))(
    lambda s, d: cl.merge(vw.classifications(s, d), vw.classifications(s, d).withColumn("status", F.lit("auto")).withColumn("deleted_at", F.lit(None).cast("timestamp"))).select("user_id", "item_id", "status")
)
query("classification_correct", W("SELECT user_id, item_id, CASE WHEN doc_id % 2 = 0 THEN 'rejected' ELSE 'confirmed' END AS status, CASE WHEN doc_id % 2 = 1 THEN 'ai' END AS primary_topic_id FROM classifications", "classifications"))(
    lambda s, d: cl.correct(vw.classifications(s, d).select("user_id", "item_id", F.array(F.lit("ai")).alias("topic_ids"), (_doc("item_id") % 2 == 0).alias("reject")), vw.articles(s, d), vw.now()).select("user_id", "item_id", "status", "primary_topic_id")
)
query("topics_restore", W(f"SELECT u.user_id, t.slug FROM (SELECT DISTINCT user_id FROM topics) u CROSS JOIN (VALUES {', '.join(f'({chr(39)}{t[0]}{chr(39)})' for t in fixed.TOPICS)}) t(slug) WHERE NOT EXISTS (SELECT 1 FROM topics x WHERE x.user_id = u.user_id AND x.slug = t.slug)", "topics"))(
    lambda s, d: cl.topics_restore(vw.topics(s, d)).select("user_id", "slug")
)
query("topic_edit", W("SELECT user_id, id, CASE WHEN slug = 'ai' THEN 'Machines' ELSE label END AS label FROM topics", "topics"))(
    lambda s, d: cl.topic_edit(vw.topics(s, d), vw.topics(s, d).select("user_id", "id", F.when(F.col("slug") == "ai", "Machines").otherwise(" ").alias("label"), F.lit("").alias("description"), F.lit(False).alias("clear")), vw.now()).select("user_id", "id", "label")
)
query("topic_slug", W(r"SELECT a.id, CASE WHEN s = '' THEN 'topic' ELSE s END AS slug FROM (SELECT id, left(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40) AS s FROM articles) a", "articles"))(lambda s, d: vw.articles(s, d).select("id", tx.slug(F.col("title")).alias("slug")))
_LABELS = r"""SELECT *, CASE WHEN s = '' THEN 'topic' ELSE s END AS base, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS turn FROM (SELECT *, left(regexp_replace(regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40) AS s FROM (
 SELECT doc_id // 20 AS user_id, doc_id AS seq, CASE doc_id % 5 WHEN 0 THEN 'AI' WHEN 1 THEN 'AI 2' WHEN 2 THEN 'A.I!' WHEN 3 THEN 'Books ' || (doc_id % 3) ELSE left(coalesce(text, ''), 3) END AS label FROM documents))"""
query("topic_add", f"""WITH RECURSIVE labels AS ({_LABELS}), walk AS (
 SELECT DISTINCT user_id, 0::BIGINT AS turn, {_T} AS taken, '' AS slug FROM labels UNION ALL
 SELECT user_id, turn, list_append(taken, slug), slug FROM (SELECT w.user_id, l.turn, w.taken, CASE WHEN list_contains(w.taken, l.base) THEN l.base || '-' || list_filter(range(2, len(w.taken) + 3), lambda n: NOT list_contains(w.taken, l.base || '-' || n))[1] ELSE l.base END AS slug
  FROM walk w JOIN labels l ON l.user_id = w.user_id AND l.turn = w.turn + 1))
SELECT l.user_id, l.seq, l.label, w.slug FROM walk w JOIN labels l ON l.user_id = w.user_id AND l.turn = w.turn""")(lambda s, d: cl.topic_add(_stored_topics(s, d), vw.added_labels(s, d), vw.now()).select("user_id", "seq", "label", "slug"))


def _stored_topics(spark, d) -> DataFrame:
    """The default topics of every reader who adds some."""
    return vw.added_labels(spark, d).select("user_id").distinct().select("user_id", F.explode(F.array(*[F.lit(t[0]) for t in fixed.TOPICS])).alias("slug"))


query("call_pacing", W("""SELECT client, seq, recent, greatest(0, CASE WHEN prev IS NULL THEN 0 ELSE 2500 - (ms - prev) END, CASE WHEN recent >= 12 THEN oldest + 60000 - ms ELSE 0 END)::BIGINT AS delay_ms FROM (
 SELECT client, seq, ms, lag(ms) OVER w AS prev, (SELECT count(*) FROM call_log b WHERE b.client = a.client AND (b.ms, b.seq) < (a.ms, a.seq) AND a.ms - b.ms < 60000) AS recent,
 (SELECT min(b.ms) FROM call_log b WHERE b.client = a.client AND (b.ms, b.seq) < (a.ms, a.seq) AND a.ms - b.ms < 60000) AS oldest FROM call_log a WINDOW w AS (PARTITION BY client ORDER BY ms, seq))""", "call_log"))(
    lambda s, d: cl.call_pacing(vw.call_log(s, d)).select("client", "seq", "recent", "delay_ms")
)


def _offered():
    return F.array(*[F.struct(F.lit(slug).alias("slug"), F.lit(label).alias("label"), F.lit(text).alias("description")) for slug, label, text in fixed.TOPICS])


_CRITERIA = ",".join(f'"{slug}":"{label} — {text}"' for slug, label, text in fixed.TOPICS)
_GIVEN = ",".join(f'{{"slug":"{slug}","label":"{label}"}}' for slug, label, _ in fixed.TOPICS)
query("decision_request", W(f"""SELECT id, sha256('{{"state":{{"title":' || to_json(title)::VARCHAR || ',"summary":' || to_json(left(CASE WHEN summary <> '' THEN summary ELSE trim(regexp_replace(coalesce(list_aggregate(paragraphs, 'string_agg', ' '), ''), '\\s+', ' ', 'g'), ' ') END, 600))::VARCHAR
 || ',"topics":[{_GIVEN}]}},"questions":{{"topic":{{"type":"choice","instructions":"{fixed.TOPIC_INSTRUCTIONS}","criteria":{{{_CRITERIA}}}}}}}}}') AS request_sha256 FROM articles""", "articles"))(
    lambda s, d: vw.articles(s, d).select("id", F.sha2(cl.request(F.col("title"), cl.classify_input(F.col("summary"), F.col("body")), _offered()), 256).alias("request_sha256"))
)
query("classify_input", W("SELECT id, left(CASE WHEN summary <> '' THEN summary ELSE trim(regexp_replace(coalesce(list_aggregate(paragraphs, 'string_agg', ' '), ''), '\\s+', ' ', 'g'), ' ') END, 600) AS input FROM articles", "articles"))(lambda s, d: vw.articles(s, d).select("id", cl.classify_input(F.col("summary"), F.col("body")).alias("input")))


def _asked():
    """Titles, summaries and topics of questions, each with a fault in some of them."""
    k = _doc() % 11
    title = F.when(k == 1, F.repeat("title", 301)).when(k == 2, F.lit(" \t")).otherwise(F.concat(F.lit("T "), "title"))
    summary = F.when(k == 3, F.repeat(F.lit("ab "), 700)).otherwise(F.col("summary"))
    topic = lambda slug, label: F.struct(F.lit(slug).alias("slug"), F.lit(label).alias("label"), F.lit("").alias("description"))
    many = F.transform(F.sequence(F.lit(1), F.lit(25)), lambda i: F.struct(F.concat(F.lit("t"), i.cast("string")).alias("slug"), F.lit("L").alias("label"), F.lit("").alias("description")))
    topics = F.when(k == 4, many).when(k == 5, F.slice(_offered(), 1, 0)).when(k == 6, F.concat(_offered(), F.array(topic("ai", "Again")))).when(k == 7, F.array(topic("a", " "))).when(k == 8, F.array(topic("a", "x" * 81))).otherwise(_offered())
    return title, summary, topics


query("decision_input_valid", W("SELECT id, CASE k WHEN 1 THEN CASE WHEN title = '' THEN 'title missing' WHEN length(title) > 0 THEN 'title too long' END WHEN 2 THEN 'title missing' WHEN 3 THEN 'summary too long' WHEN 4 THEN 'number of topics' WHEN 5 THEN 'number of topics' WHEN 6 THEN 'topics repeated' WHEN 7 THEN 'label' WHEN 8 THEN 'label' END AS error FROM (SELECT *, doc_id % 11 AS k FROM articles)", "articles"))(lambda s, d: vw.articles(s, d).select("id", cl.input_error(*_asked()).alias("error")))

# ------------------------------------------------------------------- scalars

query("fnv36", f"SELECT page_id, lower(to_base(CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END, 36)) AS id FROM (SELECT page_id, {_FNV.format('url')} AS h FROM pages)")(lambda s, d: vw.table(s, d, "pages").select("page_id", tx.fnv36(F.col("url")).alias("id")))
_NORM = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g'), ' '))"
query("fingerprint", W(f"SELECT id, lower(to_base(CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END, 36)) AS fingerprint FROM (SELECT id, {_FNV.format('k')} AS h FROM (SELECT id, {_NORM.format('title')} || chr(0) || {_NORM.format('summary')} AS k FROM articles))", "articles"))(
    lambda s, d: vw.articles(s, d).select("id", tx.fingerprint(F.col("title"), F.col("summary")).alias("fingerprint"))
)
query("monogram", r"""SELECT doc_id, CASE WHEN len(w) = 0 THEN '··' WHEN len(w) = 1 THEN upper(left(w[1], 2)) ELSE upper(left(w[1], 1) || left(w[2], 1)) END AS mark
 FROM (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N} ]', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents)""")(lambda s, d: vw.table(s, d, "documents").select("doc_id", tx.monogram(F.coalesce("text", F.lit(""))).alias("mark")))  # fmt: skip
_TEXT = r"""trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'),
 '(?i)</(p|div|section|article|li|h[1-6]|blockquote|tr)\s*>', chr(10) || chr(10), 'g'), '(?i)<br\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13))"""
query("html_to_text", f"SELECT page_id, {_TEXT} AS text FROM pages")(lambda s, d: vw.table(s, d, "pages").select("page_id", tx.html_to_text(F.col("html")).alias("text")))
_SPACE = fixed.WS.replace("'", "''")


def _scrubbed(x: str) -> str:
    for pattern in (fixed.POST_TRAILER, fixed.MORE_TRAILER, fixed.ELLIPSIS_TRAILER):
        x = f"regexp_replace({x}, '{pattern}', ' ')"
    return f"trim(regexp_replace({x}, '{_SPACE}+', ' ', 'g'), ' ')"


query("html_to_summary", rf"""SELECT page_id, CASE WHEN length(t) <= 260 THEN t ELSE trim(CASE WHEN stop > 130 THEN left(cut, stop + 1) ELSE cut END, ' ') || '…' END AS summary FROM (
 SELECT *, left(t, 260) AS cut, length(regexp_extract(left(t, 260), '(?s)^(.*)(?:[.!?] |[。！？])', 1)) AS stop FROM (SELECT page_id, {_scrubbed(_TEXT)} AS t FROM pages))""")(lambda s, d: vw.table(s, d, "pages").select("page_id", tx.html_to_summary(F.col("html")).alias("summary")))
_DECODED = "replace(replace(replace(replace(html, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;', '&')"
query("decode_entities", f"SELECT page_id, {_DECODED} || ' it’s B & ' || chr((960 + page_id % 1000)::INT) || ' &nope; &#xD800; &#99999999; &amp é' AS text FROM pages")(
    lambda s, d: vw.table(s, d, "pages").select("page_id", tx.decode_entities(F.concat("html", F.lit(" it&#8217;s &#x42; &AMP; &#"), (960 + F.col("page_id") % 1000).cast("string"), F.lit("; &nope; &#xD800; &#99999999; &amp &#xE9;"))).alias("text"))
)
query("scrub_boilerplate", W(f"SELECT id, {_scrubbed("summary || ' Read more »'")} AS scrubbed FROM articles", "articles"))(lambda s, d: vw.articles(s, d).select("id", tx.scrub_boilerplate(F.concat("summary", F.lit(" Read more »"))).alias("scrubbed")))
_CUED = "summary || CASE WHEN doc_id % 2 = 0 THEN ' Continue reading' ELSE ' xxxxxxxxxxxxxxxxxxx' END"
query("read_more_cue", W(f"SELECT id, regexp_matches(right({_TEXT.replace('html', _CUED, 1)}, 160), '{fixed.READ_MORE_CUE}') AS cue FROM articles", "articles"))(
    lambda s, d: vw.articles(s, d).select("id", tx.read_more_cue(F.concat("summary", F.when(_doc() % 2 == 0, " Continue reading").otherwise(" xxxxxxxxxxxxxxxxxxx"))).alias("cue"))
)
query("resolve_url", r"""SELECT page_id, raw, CASE WHEN regexp_matches(raw, '^https?://') THEN raw WHEN starts_with(raw, '//') THEN 'https:' || raw WHEN starts_with(raw, '/') THEN origin || raw WHEN regexp_matches(raw, '(?i)^[a-z][a-z0-9+.-]*:') THEN NULL ELSE folder || raw END AS href FROM (
 SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1)) || ['mailto:a@b.example', '//c.example/d', 'e/f']) AS raw, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin,
 CASE WHEN regexp_matches(url, '^https?://[^/]+/') THEN regexp_extract(url, '^(https?://.*/)[^/]*$', 1) ELSE url || '/' END AS folder FROM pages)""")(
    lambda s, d: vw.table(s, d, "pages").select("page_id", "url", F.explode(F.concat(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))), F.array(*map(F.lit, ("mailto:a@b.example", "//c.example/d", "e/f"))))).alias("raw")).select("page_id", "raw", urls.resolve_common(F.col("raw"), F.col("url")).alias("href"))
)
query("feed_url_normalize", "SELECT page_id, url AS normal FROM pages")(lambda s, d: vw.table(s, d, "pages").select("page_id", urls.normalize_feed_url(F.concat(F.lit("  "), "url", F.lit("\n"))).alias("normal")))
query("host_of", "SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^/:]+)', 1), '^www\\.', '') AS host FROM pages")(lambda s, d: vw.table(s, d, "pages").select("page_id", urls.host_of(F.col("url")).alias("host")))
query("url_safe_http", "SELECT page_id, page_id % 2 = 0 AS safe FROM pages")(lambda s, d: vw.table(s, d, "pages").select("page_id", urls.is_safe_http(F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("javascript:"), "url"))).alias("safe")))
query("url_public_target", """SELECT page_id, CASE WHEN page_id % 4 < 2 THEN page_id % 2 = 0 WHEN page_id % 4 = 3 THEN page_id % 8 = 3 ELSE NOT (a IN (0, 10, 127) OR a = 169 AND b = 254 OR a = 172 AND b BETWEEN 16 AND 31 OR a = 192 AND b = 168 OR a = 100 AND b BETWEEN 64 AND 127) END AS public
 FROM (SELECT page_id, [0, 10, 127, 169, 172, 192, 100, 8][1 + length(html) % 8] AS a, length(html) % 256 AS b FROM pages)""")(
    lambda s, d: vw.table(s, d, "pages").select("page_id", urls.is_public_target(_target()).alias("public"))
)


def _target():
    """Each page's own address, or with another scheme, or an IPv4 one made from its length, or an IPv6 one."""
    k, n = F.col("page_id") % 4, F.length("html")
    octets = F.concat(F.get(F.array(*[F.lit(str(x)) for x in (0, 10, 127, 169, 172, 192, 100, 8)]), n % 8), F.lit("."), F.when(n % 256 >= 0, (n % 256).cast("string")), F.lit(".1.2"))
    v6 = F.when(F.col("page_id") % 8 == 3, "http://[2001:db8::1]/").otherwise("http://[fe80::1]/")
    return F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("ftp"), F.substring_index("url", "http", -1))).when(k == 2, F.concat(F.lit("http://"), octets, F.lit("/x"))).otherwise(v6)


def _hrefs():
    return F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))


_HREFS_SQL = """regexp_extract_all(html, 'href="([^"]*)"', 1)"""
query("image_junk", f"""SELECT page_id, u, regexp_matches(u, '{fixed.JUNK_IMAGE_URL}') OR coalesce(try_cast(nullif(regexp_extract(u, '{fixed.IMAGE_BOX}', 1), '') AS INT) <= 200 OR try_cast(nullif(regexp_extract(u, '{fixed.IMAGE_BOX}', 2), '') AS INT) BETWEEN 1 AND 120, false) AS junk
 FROM (SELECT DISTINCT page_id, 'https://img.example/' || h || '/' || (length(html) % 400) || 'x' || (length(html) % 300) || '/a.jpg' AS u FROM (SELECT page_id, html, unnest({_HREFS_SQL}) AS h FROM pages))""")(
    lambda s, d: vw.table(s, d, "pages").select("page_id", "html", F.explode(_hrefs()).alias("h")).select("page_id", F.concat(F.lit("https://img.example/"), "h", F.lit("/"), (F.length("html") % 400).cast("string"), F.lit("x"), (F.length("html") % 300).cast("string"), F.lit("/a.jpg")).alias("u")).distinct().select("page_id", "u", urls.is_junk_image_url(F.col("u")).alias("junk"))
)
query("image_identity", "SELECT page_id, lower(regexp_replace(split_part(url, '?', 1), '[/#]+$', '')) AS identity FROM pages")(lambda s, d: vw.table(s, d, "pages").select("page_id", urls.image_identity(F.concat(F.lit("https://proxy.example/r?u="), "url")).alias("identity")))
query("distinct_links", r"""SELECT page_id, array_to_string(list_filter(h, lambda x, i: list_position(h, x) = i), ' ') AS links FROM (SELECT page_id, regexp_extract_all(html, '<a\b[^>]*href="([^"]*)"', 1) AS h FROM pages)""")(lambda s, d: vw.table(s, d, "pages").select("page_id", F.array_join(pg.distinct_links(F.col("html")), " ").alias("links")))
query("clean_title", W("SELECT id, CASE WHEN title = '' THEN '| Daily Post' ELSE title END AS cleaned FROM (SELECT id, trim(regexp_replace(title, '\\s+', ' ', 'g'), ' ') AS title FROM articles)", "articles"))(
    lambda s, d: vw.articles(s, d).select("id", tx.clean_title(F.concat(tx.collapse(F.col("title")), F.lit(" | Daily Post")), F.lit("daily post")).alias("cleaned"))
)
query("story_layout", W("SELECT id, CASE WHEN summary = '' THEN 'brief' WHEN doc_id % 3 = 0 THEN 'standard' ELSE 'compact' END AS layout FROM articles", "articles"))(lambda s, d: vw.articles(s, d).select("id", bl.story_layout(F.when(_doc() % 3 == 0, "x.jpg").when(_doc() % 3 == 1, ""), F.col("summary")).alias("layout")))
query("content_state_repair", W("SELECT id, CASE WHEN summary <> '' AND trim(regexp_replace(list_aggregate(paragraphs, 'string_agg', ' '), '\\s+', ' ', 'g'), ' ') = summary THEN 'summary' ELSE 'full' END AS state FROM articles", "articles"))(lambda s, d: vw.articles(s, d).select("id", bl.repaired_content_state(F.lit("full"), F.col("body"), F.col("summary")).alias("state")))
query("content_state", W(f"SELECT id, CASE WHEN doc_id % 7 = 0 THEN 'truncated' WHEN doc_id % 3 = 0 OR doc_id % 5 = 1 OR summary <> '' AND trim(regexp_replace(list_aggregate(paragraphs, 'string_agg', ' '), '\\s+', ' ', 'g'), ' ') = summary THEN 'summary' ELSE 'full' END AS state FROM articles", "articles"))(
    lambda s, d: vw.articles(s, d).select("id", bl.content_state(_doc() % 3 > 0, tx.read_more_cue(F.concat("summary", F.when(_doc() % 5 == 1, "<p>Continue reading</p>").otherwise("<p>The end of it</p>"))), F.col("body"), F.col("summary"), _doc() % 7 == 0).alias("state"))
)
query("reading_minutes", W("SELECT id, greatest(1, floor(coalesce(list_sum(list_transform(paragraphs, lambda p: len(regexp_extract_all(p, '\\S+')) / 225.0::DOUBLE)), 0) + 0.5))::INT AS minutes FROM articles", "articles"))(lambda s, d: vw.articles(s, d).select("id", bl.reading_minutes(F.col("body")).alias("minutes")))
query("blocks_to_text", W("SELECT id, trim(regexp_replace(coalesce(list_aggregate(paragraphs, 'string_agg', ' '), ''), '\\s+', ' ', 'g'), ' ') AS text FROM articles", "articles"))(lambda s, d: vw.articles(s, d).select("id", bl.blocks_to_text(F.col("body")).alias("text")))
query("paragraph_texts", W("SELECT id, len(list_filter(paragraphs, lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'), ' ') <> ''))::INT AS n FROM articles", "articles"))(lambda s, d: vw.articles(s, d).select("id", F.size(bl.paragraph_texts(F.col("body"))).alias("n")))
query("block_text", W("SELECT id, coalesce(paragraphs[1], '') AS first FROM articles", "articles"))(lambda s, d: vw.articles(s, d).select("id", F.coalesce(bl.block_text(F.get("body", F.lit(0))), F.lit("")).alias("first")))
query("blocks_dedupe", W("SELECT id, (1 + len(list_filter(range(1, len(pp) + 1), lambda i: i = 1 OR pp[i] <> pp[i - 1])))::INT AS n FROM (SELECT id, paragraphs || paragraphs AS pp FROM articles)", "articles"))(
    lambda s, d: vw.articles(s, d).select("id", F.size(bl.dedupe(F.concat(F.array(vw.block(kind=F.lit("figure"), src=F.lit("u"))), "body", "body", F.array(vw.block(kind=F.lit("figure"), src=F.lit("u")))))).alias("n"))
)
query("body_leads_with_media", W("SELECT id, doc_id % 2 = 0 AS leads FROM articles", "articles"))(
    lambda s, d: vw.articles(s, d).select("id", bl.leads_with_media(F.when(_doc() % 2 == 0, F.concat(F.array(vw.block(kind=F.lit("figure"), src=F.lit("u"))), "body")).otherwise(F.col("body"))).alias("leads"))
)
query("first_figure_src", W("SELECT id, CASE WHEN doc_id % 4 > 0 THEN 'u' || (doc_id % 4) END AS src FROM articles", "articles"))(
    lambda s, d: vw.articles(s, d).select("id", bl.first_figure_src(F.concat("body", F.when(_doc() % 4 > 0, F.array(vw.block(kind=F.lit("figure"), src=F.concat(F.lit("u"), (_doc() % 4).cast("string"))), vw.block(kind=F.lit("figure"), src=F.lit("v")))).otherwise(F.slice("body", 1, 0)))).alias("src"))
)
query("strip_cover_copy", W("SELECT id, (len(paragraphs) + doc_id % 2)::INT AS n FROM articles", "articles"))(
    lambda s, d: vw.articles(s, d).select("id", F.size(bl.strip_cover_copy(F.concat(F.array(vw.block(kind=F.lit("figure"), src=F.lit("https://x.example/A.jpg?w=3"))), "body"), F.when(_doc() % 2 == 0, "https://x.example/a.jpg").otherwise("https://x.example/b.jpg"))).alias("n"))
)
query("distinct_images", f"SELECT page_id, array_to_string(list_filter(h, lambda x, i: list_position(h, x) = i), ',') AS images FROM (SELECT page_id, {_HREFS_SQL} || list_reverse({_HREFS_SQL}) AS h FROM pages)")(
    lambda s, d: vw.table(s, d, "pages").select("page_id", F.array_join(F.transform(bl.dedupe(F.transform(F.concat(_hrefs(), F.reverse(_hrefs())), lambda h: vw.block(kind=F.lit("figure"), src=h))), lambda b: b["src"]), ",").alias("images"))
)
_SIZED = f"(SELECT page_id, i, h, length(h) * 150 AS w FROM (SELECT page_id, unnest(range(len({_HREFS_SQL}))) AS i, replace(unnest({_HREFS_SQL}), ',', '') AS h FROM pages) WHERE h <> '')"
query("best_image", f"SELECT p.page_id, coalesce(arg_min(h, (w, i)) FILTER (w >= 1200), arg_min(h, (-w, i))) AS url FROM pages p LEFT JOIN {_SIZED} c ON c.page_id = p.page_id GROUP BY p.page_id")(
    lambda s, d: vw.table(s, d, "pages").select("page_id", bl.best_image(bl.srcset_candidates(F.array_join(F.transform(F.transform(_hrefs(), lambda h: F.replace(h, F.lit(","), F.lit(""))), lambda h: F.when(h != "", F.concat(h, F.lit(" "), (F.length(h) * 150).cast("string"), F.lit("w"))).otherwise("")), ", "))).alias("url"))
)
query("ago_label", S("""SELECT user_id, id, CASE WHEN minutes_ago < 60 THEN greatest(1, minutes_ago)::BIGINT || ' min ago' WHEN minutes_ago < 1440 THEN h || CASE WHEN h = 1 THEN ' hr ago' ELSE ' hrs ago' END WHEN d = 1 THEN 'yesterday' WHEN d < 7 THEN d || ' days ago'
 WHEN d < 365 THEN w || CASE WHEN w = 1 THEN ' week ago' ELSE ' weeks ago' END ELSE (d // 365) || CASE WHEN d // 365 = 1 THEN ' year ago' ELSE ' years ago' END END AS label FROM (
 SELECT *, floor(d / 7.0::DOUBLE + 0.5)::BIGINT AS w FROM (SELECT *, floor(minutes_ago / 60.0::DOUBLE + 0.5)::BIGINT AS h, floor(minutes_ago / 1440.0::DOUBLE + 0.5)::BIGINT AS d FROM stories))"""))(lambda s, d: _stories(s, d).select("user_id", "id", tx.ago_label(F.col("minutes_ago")).alias("label")))  # fmt: skip
query("published_label", W("SELECT id, strftime(published_at, '%-d %B %Y') AS label FROM articles", "articles"))(lambda s, d: vw.articles(s, d).select("id", tx.published_label(F.col("published_at")).alias("label")))
query("parse_date", "SELECT event_id, date_trunc('second', ts) AS a, date_trunc('second', ts) AS b FROM events")(
    lambda s, d: vw.table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("t")).select("event_id", tx.parse_date(F.date_format("t", "EEE, d MMM yyyy HH:mm:ss 'GMT'")).alias("a"), tx.parse_date(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("b"))
)
query("clamp01", "SELECT event_id, least(1, greatest(0, value / 100))::DOUBLE AS clamped FROM events")(lambda s, d: vw.table(s, d, "events").select("event_id", tx.clamp01(F.col("value") / 100).alias("clamped")))
query("scroll_progress", W("SELECT user_id, item_id, ts, CASE WHEN scroll_height - client_height <= 8 THEN 0 ELSE least(1, greatest(0, scroll_top / (scroll_height - client_height))) END::DOUBLE AS progress FROM scroll_events", "scroll_events"))(
    lambda s, d: vw.scroll_events(s, d).select("user_id", "item_id", "ts", tx.scroll_progress(F.col("scroll_top"), F.col("scroll_height"), F.col("client_height")).alias("progress"))
)
_CREDIT = W("""SELECT user_id, item_id, min(CASE WHEN room >= 240 AND scroll_top >= room - 24 THEN ts WHEN room < 240 AND (nxt IS NULL OR nxt >= ts + INTERVAL 2 SECOND) THEN ts + INTERVAL 2 SECOND END) AS credited_at FROM (
 SELECT *, scroll_height - client_height AS room, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, item_id) AS nxt FROM scroll_events) GROUP BY ALL HAVING min(CASE WHEN room >= 240 AND scroll_top >= room - 24 THEN ts WHEN room < 240 AND (nxt IS NULL OR nxt >= ts + INTERVAL 2 SECOND) THEN ts END) IS NOT NULL""", "scroll_events")
query("read_credit", _CREDIT)(lambda s, d: sm.read_credit(vw.scroll_events(s, d)))
query("video_url_parse", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'youtube' WHEN 1 THEN 'vimeo' END AS provider, CASE page_id % 3 WHEN 0 THEN left(md5(html), 11) WHEN 1 THEN length(html)::VARCHAR END AS video_id FROM pages")(
    lambda s, d: vw.table(s, d, "pages").select("page_id", urls.video_of(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://www.youtube.com/embed/"), F.left(F.md5("html"), F.lit(11)), F.lit("?x=1"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://player.vimeo.com/video/"), F.length("html").cast("string"))).otherwise(F.col("url"))).alias("v")).select("page_id", "v.provider", "v.video_id")
)
query("decode_obfuscated_email", "SELECT page_id, regexp_extract(url, '^https?://([^/:]+)', 1) || '@x.example' AS address FROM pages")(
    lambda s, d: vw.table(s, d, "pages").select("page_id", F.concat(F.try_parse_url("url", F.lit("HOST")), F.lit("@x.example")).alias("a")).select("page_id", urls.decode_email(F.concat(F.lit("2a"), F.array_join(F.transform(F.split("a", ""), lambda c: F.lpad(F.lower(F.hex(F.ascii(c).bitwiseXOR(F.lit(0x2A)))), 2, "0")), ""))).alias("address"))
)


# ----------------------------------------------------------------- streaming

query("stream_reading_state", W("SELECT user_id, item_id, read, saved, later, seq FROM reading", "reading"))(sm.reading_state_query)
query("stream_changes", W(f"SELECT user_id, item_id, seq FROM reading_changes WHERE updated_at > {NOW} - INTERVAL 10 DAY", "reading_changes"))(sm.changes_query)
query("stream_edition_counts", ORACLES["edition_counts"])(sm.edition_counts_query)
query("rate_windows_classify", W("SELECT client, time_bucket(INTERVAL 60 SECOND, ts) AS window_start, count(*) AS calls, count(*) > 60 AS limited FROM call_log GROUP BY ALL", "call_log"))(lambda s, d: sm.rate_windows_query(s, d, fixed.CLASSIFY_LIMIT))
query("rate_windows", W("SELECT client, time_bucket(INTERVAL 60 SECOND, ts) AS window_start, count(*) AS calls, count(*) > 40 AS limited FROM call_log GROUP BY ALL", "call_log"))(sm.rate_windows_query)
query("stream_pacing", ORACLES["call_pacing"])(sm.pacing_query)
query("stream_read_credit", _CREDIT)(sm.read_credit_query)
#: A refreshed feed has its 20 first items and what readers have kept; feeds of removed sources stay as they are.
_REFRESHED = W("SELECT a.source_id || '.' || (a.doc_id // 800) AS source_id, CASE WHEN any_value(s.deleted_at) IS NOT NULL THEN count(*) ELSE least(20, count(*)) + count(r.item_id) END AS articles FROM articles a JOIN sources s ON s.id = a.source_id LEFT JOIN (SELECT DISTINCT item_id FROM reading WHERE saved OR later) r ON r.item_id = a.id GROUP BY ALL", "articles", "sources", "reading")
query("stream_ingest", _REFRESHED)(sm.ingest_query)

# ----------------------------------------------------------------- workloads

query("feed_refresh", _REFRESHED)(lambda s, d: wl.feed_refresh(vw.feed_documents(s, d), vw.feed_sources(s, d), vw.feed_articles(s, d), _reading(s, d), vw.now()).groupBy("source_id").agg(F.count(F.lit(1)).alias("articles")))
query("edition", S("SELECT user_id, id, rank::INT AS rank FROM (SELECT s.*, row_number() OVER (PARTITION BY s.user_id ORDER BY minutes_ago, id) AS rank FROM stories s WHERE minutes_ago < 1440 AND NOT EXISTS (SELECT 1 FROM reading r WHERE r.user_id = s.user_id AND r.item_id = s.id AND r.read)) WHERE rank <= 50", "reading"))(
    lambda s, d: wl.edition(vw.articles(s, d), vw.sources(s, d), vw.classifications(s, d), _reading(s, d), vw.now(), "today", 50).select("user_id", "id", "rank")
)
