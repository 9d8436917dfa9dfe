"""The library's tables as views over the driver's ones, with SQL twins in ``VIEW_SQL``.

``AS_OF`` is the fixed clock of all queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed, schemas

AS_OF = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def minutes_before(ts: Column, minutes: Column) -> Column:
    return F.timestamp_millis(F.unix_millis(ts) - minutes.cast("long") * 60_000)


def block(**fields: Column) -> Column:
    """A block with the given fields, the others null."""
    names = [part.split(":")[0].strip() for part in ("kind, text, cite, inline, items, inline_items, src, caption, seed, provider, video_id, title").split(",")]
    return F.struct(*[fields.get(n, F.lit(None)).alias(n) for n in names]).cast(schemas.BLOCK)


def _n(source: str = "source") -> Column:
    return F.substring(source, 4, 9).cast("int")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One per distinct source; its reader is its number modulo 4."""
    n = _n("id")
    ids = table(spark, sf_dir, "documents").where("source IS NOT NULL").select(F.col("source").alias("id")).distinct()
    folder = F.get(F.array(*map(F.lit, fixed.FOLDERS)), n % 8)
    at = lambda minutes: minutes_before(now(), minutes)
    return ids.select(
        (n % 4).cast("long").alias("user_id"),
        "id",
        F.concat(F.lit("https://"), "id", F.lit(".example/feed.xml")).alias("url"),
        F.concat(F.lit("https://"), "id", F.lit(".example/")).alias("site_url"),
        F.concat(F.lit("Source "), n.cast("string")).alias("title"),
        F.concat("id", F.lit(".example")).alias("host"),
        folder.alias("folder"),
        at(n * 10 + 100).alias("added_at"),
        at(n * 10).alias("fetched_at"),
        F.lit(None).cast("string").alias("error"),
        at(n * 10).alias("updated_at"),
        F.when(n % 10 == 9, at(n)).alias("deleted_at"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One per document, with a paragraph a line."""
    text = F.coalesce("text", F.lit(""))
    d = table(spark, sf_dir, "documents").where("source IS NOT NULL").withColumn("text", text)
    summary = F.trim(F.left(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit(200)))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    body = F.transform(lines, lambda x: block(kind=F.lit("p"), text=x))
    old = F.col("doc_id") % 3 == 0
    checked = minutes_before(now(), F.col("doc_id") % 900)
    return d.select(
        F.concat_ws("~", "source", "doc_id").alias("id"),
        F.col("source").alias("source_id"),
        F.left(F.substring_index("text", "\n", 1), F.lit(60)).alias("title"),
        F.when(F.col("doc_id") % 11 > 0, F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string"))).alias("link"),
        F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("Author "), (F.col("doc_id") % 7).cast("string"))).alias("author"),
        minutes_before(now(), F.col("doc_id") * 2).alias("published_at"),
        minutes_before(now(), F.col("doc_id") % 50).alias("fetched_at"),
        summary.alias("summary"),
        body.alias("body"),
        F.lit(None).cast("string").alias("image"),
        F.lit(None).cast("boolean").alias("has_cover"),
        F.lit(None).cast("string").alias("image_caption"),
        F.lit(None).cast("boolean").alias("video_page"),
        F.greatest(F.lit(1), F.floor(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) / 225.0 + 0.5)).cast("int").alias("minutes"),
        F.when(summary == "", "brief").otherwise("compact").alias("layout"),
        F.when(F.col("doc_id") % 4 == 0, "summary").otherwise("full").alias("content_state"),
        F.when(old, "success").when(F.col("doc_id") % 3 == 1, "failed").otherwise("idle").alias("extraction_state"),
        F.when(old, checked).alias("content_fetched_at"),
        F.when(F.col("doc_id") % 3 < 2, checked).alias("content_checked_at"),
        F.lit(None).cast("string").alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        F.when(F.col("doc_id") % 7 > 0, 12).otherwise(11).alias("extractor_version"),
    )


def reading_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changelog of reading state: every event sets the state of one item for one reader."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "user_id",
        F.concat(F.lit("src"), (k % 20).cast("string"), F.lit("~"), k.cast("string")).alias("item_id"),
        (kind == "view").alias("read"),
        (kind == "purchase").alias("saved"),
        (kind == "click").alias("later"),
        F.col("ts").cast("timestamp").alias("updated_at"),
        F.col("event_id").alias("seq"),
    )


def classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One per labelled document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source").where("source IS NOT NULL")
    rows = table(spark, sf_dir, "labels").join(d, "doc_id")
    topic = lambda shift: F.get(F.array(*[F.lit(t[0]) for t in fixed.TOPICS]), ((F.col("doc_id") + shift) % 12).cast("int"))
    confidence = F.lit(0.35) + F.col("quality") * 0.3 + F.col("toxic") * 0.1
    return rows.select(
        (F.substring("source", 4, 9).cast("int") % 4).cast("long").alias("user_id"),
        F.concat_ws("~", "source", "doc_id").alias("item_id"),
        F.array(topic(0), topic(5)).alias("topic_ids"),
        topic(0).alias("primary_topic_id"),
        confidence.alias("confidence"),
        F.when(F.col("doc_id") % 10 == 0, "confirmed").when(F.col("doc_id") % 10 == 1, "rejected").when(confidence >= 0.6, "auto").otherwise("needs_review").alias("status"),
        F.lit("sample").alias("provider"),
        F.lit(None).cast("string").alias("model"),
        F.concat(F.lit("f"), (F.col("doc_id") % 6).cast("string")).alias("content_fingerprint"),
        minutes_before(now(), F.col("doc_id")).alias("updated_at"),
        F.when(F.col("doc_id") % 13 == 0, now()).alias("deleted_at"),
    )


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default topics of every reader of a source, less one by reader."""
    every = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(x).alias(n) for n, x in zip(("slug", "label", "description"), t)]) for i, t in enumerate(fixed.TOPICS)])
    rows = sources(spark, sf_dir).select("user_id").distinct().select("user_id", F.inline(every)).where(F.col("i") != F.col("user_id"))
    return rows.select("user_id", F.col("slug").alias("id"), "slug", "label", "description", F.lit(True).alias("builtin"), now().alias("updated_at"), F.lit(None).cast("timestamp").alias("deleted_at"))


def scroll_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scroll telemetry: how far a reader is in a story."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        "user_id",
        F.concat(F.lit("src"), (k % 20).cast("string"), F.lit("~"), k.cast("string")).alias("item_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_id") % 1000).cast("double").alias("scroll_top"),
        (F.lit(800) + k * 10).cast("double").alias("scroll_height"),
        F.lit(800.0).alias("client_height"),
    )


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by client, with time drawn together so that some fall within a minute."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("client"), F.timestamp_millis(F.floor(ms / 5000).cast("long")).alias("ts"), F.col("event_id").alias("seq"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded classifier responses in four forms, some of them failures."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source").where("source IS NOT NULL")
    rows = table(spark, sf_dir, "labels").join(d, "doc_id")
    topic = lambda shift: F.get(F.array(*[F.lit(t[0]) for t in fixed.TOPICS]), ((F.col("doc_id") + shift) % 12).cast("int"))
    choice = F.when(F.col("doc_id") % 17 == 0, "nonsense").otherwise(topic(0))
    p = (F.lit(50) + F.col("doc_id") % 40) / 100
    q = (F.col("doc_id") % 30) / 100
    as_map = F.format_string('{"answers":{"topic":{"type":"choice","choice":"%s","confidence":%s,"probabilities":{"%s":%s,"%s":%s}}},"model":"m1"}', choice, p.cast("string"), choice, p.cast("string"), topic(3), q.cast("string"))
    as_list = F.format_string('{"answers":[{"type":"choice","choice":"%s","confidence":%s,"probabilities":[{"value":"%s","probability":%s}]}],"model":"m2"}', choice, p.cast("string"), topic(3), q.cast("string"))
    form = F.col("doc_id") % 4
    failed = F.when(form == 0, '{"success":false,"errors":[{"message":"no quota"}]}').when(form == 1, '{"code":7,"message":"refused"}').when(form == 2, '{"error":"broken"}').otherwise('{"error":{"message":"denied"}}')
    body = F.when(F.col("doc_id") % 19 == 0, failed).when(form == 0, F.concat(F.lit('{"success":true,"result":'), as_map, F.lit("}"))).when(form == 1, F.concat(F.lit('{"code":0,"data":'), as_map, F.lit("}"))).when(form == 2, as_map).otherwise(as_list)
    return rows.select(F.concat_ws("~", "source", "doc_id").alias("item_id"), F.when(form == 3, "list").otherwise("map").alias("provider"), body.alias("response_json"), "doc_id")


#: Ids whose documents of one source make a feed.
FEED_SPAN = 800


def feed_part(doc_id: Column) -> Column:
    return F.floor(doc_id / FEED_SPAN).cast("long")


def feed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources with one row for each of their feeds, named after it."""
    parts = table(spark, sf_dir, "documents").where("source IS NOT NULL").select(F.col("source").alias("id"), feed_part(F.col("doc_id")).alias("part")).distinct()
    s = sources(spark, sf_dir).join(parts, "id")
    part = F.col("part").cast("string")
    new = {"id": F.concat_ws(".", "id", part), "url": F.concat(F.col("site_url"), F.lit("feed-"), part, F.lit(".xml"))}
    return s.select(*[new.get(c, F.col(c)).alias(c) for c in sources(spark, sf_dir).columns])


def feed_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles, each of the source of its feed."""
    part = feed_part(F.substring_index("id", "~", -1).cast("long")).cast("string")
    return articles(spark, sf_dir).withColumn("source_id", F.concat_ws(".", "source_id", part))


def feed_documents(spark: SparkSession, sf_dir: str, blank: int = 0) -> DataFrame:
    """Feeds of each source, one for every ``FEED_SPAN`` ids: RSS, Atom or RDF by the source's number, with its documents as entries.

    With ``blank``, each so many documents give an entry with neither title nor text.
    """
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    d = table(spark, sf_dir, "documents").where("source IS NOT NULL").withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", ""))
    n = _n()
    title = esc(F.left(F.substring_index("text", "\n", 1), F.lit(60)))
    html = esc(F.concat(F.lit("<p>"), F.replace(esc("text"), F.lit("\n"), F.lit("</p><p>")), F.lit("</p>")))
    if blank:
        bare = F.col("doc_id") % blank == 0
        title, html = (F.when(bare, "").otherwise(c) for c in (title, html))
    link = F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string"))
    rss = F.format_string("<item><title>%s</title><link>%s</link><guid>%s</guid><dc:creator>A %s</dc:creator><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate><content:encoded>%s</content:encoded></item>", title, link, F.col("doc_id").cast("string"), (F.col("doc_id") % 7).cast("string"), html)
    atom = F.format_string('<entry><title>%s</title><link rel="self" href="/self"/><link rel="alternate" type="text/html" href="/%s"/><id>urn:%s</id><published>2024-01-01T00:00:00Z</published><content type="html">%s</content></entry>', title, F.col("doc_id").cast("string"), F.col("doc_id").cast("string"), html)
    rdf = F.format_string('<item rdf:about="%s"><title>%s</title><link>%s</link><dc:date>2024-01-01</dc:date><description>%s</description></item>', link, title, link, html)
    entry = F.when(n % 3 == 0, rss).when(n % 3 == 1, atom).otherwise(rdf)
    e = d.select("source", n.alias("n"), feed_part(F.col("doc_id")).alias("part"), F.struct("doc_id", entry.alias("entry")).alias("e"))
    g = e.groupBy("source", "n", "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda x: x["entry"]), "").alias("entries"))
    name = F.concat(F.lit("Source "), F.col("n").cast("string"))
    site = F.concat(F.lit("https://"), "source", F.lit(".example/"))
    body = (
        F.when(F.col("n") % 3 == 0, F.format_string('<?xml version="1.0"?><rss version="2.0" xmlns:dc="d" xmlns:content="c"><channel><title>%s</title><link>%s</link><description>About it</description>%s</channel></rss>', name, site, F.col("entries")))
        .when(F.col("n") % 3 == 1, F.format_string('<?xml version="1.0"?><feed xmlns="a"><title>%s</title><subtitle>About it</subtitle><author><name>Desk</name></author><link rel="alternate" href="%s"/>%s</feed>', name, site, F.col("entries")))
        .otherwise(F.format_string('<?xml version="1.0"?><rdf:RDF xmlns:rdf="r" xmlns:dc="d"><channel rdf:about="%s"><title>%s</title><link>%s</link></channel>%s</rdf:RDF>', site, name, site, F.col("entries")))
    )
    return g.select(F.concat(site, F.lit("feed-"), F.col("part").cast("string"), F.lit(".xml")).alias("feed_url"), F.lit("application/xml").alias("content_type"), body.alias("body"))


def loose_feed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feeds as published ones often are: references of HTML, bare ampersands and tags in titles, open ``br``; each seventh broken off."""
    ending = F.lit(" &nbsp;x & y &mdash; <b>bold</b> 1 < 2<br>end</title>")
    body = F.regexp_replace("body", "</title>", ending)
    cut = F.pmod(F.crc32(F.encode("feed_url", "utf-8")), F.lit(7)) == 0
    return feed_documents(spark, sf_dir).withColumn("body", F.when(cut, F.concat(F.get(F.split(body, "<(?:item|entry)[ >]", 2), F.lit(0)), F.lit("<item <entry"))).otherwise(body))


def added_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of new topics: twenty documents' for each reader, many of them alike or like stored topics."""
    k = F.col("doc_id") % 5
    label = F.when(k == 0, "AI").when(k == 1, "AI 2").when(k == 2, "A.I!").when(k == 3, F.concat(F.lit("Books "), (F.col("doc_id") % 3).cast("string"))).otherwise(F.left(F.coalesce("text", F.lit("")), F.lit(3)))
    return table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 20).cast("long").alias("user_id"), F.col("doc_id").alias("seq"), label.alias("label"))


def _topic_sql(shift: int) -> str:
    return "[" + ", ".join(f"'{t[0]}'" for t in fixed.TOPICS) + f"][1 + (doc_id + {shift}) % 12]"


_NOW = f"TIMESTAMP '{AS_OF}'"

#: The views in DuckDB's SQL (bodies are lists of paragraphs there).
VIEW_SQL = {
    "sources": f"""SELECT n % 4 AS user_id, id, 'https://' || id || '.example/feed.xml' AS url, 'https://' || id || '.example/' AS site_url, 'Source ' || n AS title,
      id || '.example' AS host, CASE n % 8 {" ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(fixed.FOLDERS))} END AS folder,
      {_NOW} - to_minutes(n * 10 + 100) AS added_at, {_NOW} - to_minutes(n * 10) AS fetched_at, NULL::VARCHAR AS error, {_NOW} - to_minutes(n * 10) AS updated_at,
      CASE WHEN n % 10 = 9 THEN {_NOW} - to_minutes(n) END AS deleted_at
      FROM (SELECT DISTINCT source AS id, substr(source, 4)::BIGINT AS n FROM documents WHERE source IS NOT NULL)""",
    "articles": rf"""SELECT source || '~' || doc_id AS id, source AS source_id, doc_id, left(split_part(t, chr(10), 1), 60) AS title,
      CASE WHEN doc_id % 11 > 0 THEN 'https://' || source || '.example/' || doc_id END AS link, CASE WHEN doc_id % 5 > 0 THEN 'Author ' || (doc_id % 7) END AS author,
      {_NOW} - to_minutes(doc_id * 2) AS published_at, {_NOW} - to_minutes(doc_id % 50) AS fetched_at, trim(left(trim(regexp_replace(t, '\s+', ' ', 'g'), ' '), 200), ' ') AS summary,
      list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ') <> '') AS paragraphs,
      greatest(1, floor(len(regexp_extract_all(t, '\S+')) / 225.0::DOUBLE + 0.5))::INT AS minutes, CASE WHEN trim(left(trim(regexp_replace(t, '\s+', ' ', 'g'), ' '), 200), ' ') = '' THEN 'brief' ELSE 'compact' END AS layout,
      CASE WHEN doc_id % 4 = 0 THEN 'summary' ELSE 'full' END AS content_state, CASE doc_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'failed' ELSE 'idle' END AS extraction_state,
      CASE WHEN doc_id % 3 = 0 THEN {_NOW} - to_minutes(doc_id % 900) END AS content_fetched_at, CASE WHEN doc_id % 3 < 2 THEN {_NOW} - to_minutes(doc_id % 900) END AS content_checked_at,
      CASE WHEN doc_id % 7 > 0 THEN 12 ELSE 11 END AS extractor_version
      FROM (SELECT *, coalesce(text, '') AS t FROM documents WHERE source IS NOT NULL)""",
    "reading_changes": """SELECT user_id, 'src' || (k % 20) || '~' || k AS item_id, event_type = 'view' AS read, event_type = 'purchase' AS saved, event_type = 'click' AS later, ts AS updated_at, event_id AS seq
      FROM (SELECT *, (props->>'$.k')::INT AS k FROM events)""",
    "reading": "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY updated_at DESC, seq DESC) AS rn FROM reading_changes) WHERE rn = 1",
    "classifications": f"""SELECT substr(source, 4)::BIGINT % 4 AS user_id, source || '~' || doc_id AS item_id, doc_id, [{_topic_sql(0)}, {_topic_sql(5)}] AS topic_ids, {_topic_sql(0)} AS primary_topic_id,
      confidence, CASE WHEN doc_id % 10 = 0 THEN 'confirmed' WHEN doc_id % 10 = 1 THEN 'rejected' WHEN confidence >= 0.6 THEN 'auto' ELSE 'needs_review' END AS status,
      'f' || (doc_id % 6) AS content_fingerprint, {_NOW} - to_minutes(doc_id) AS updated_at, CASE WHEN doc_id % 13 = 0 THEN {_NOW} END AS deleted_at
      FROM (SELECT *, 0.35::DOUBLE + quality * 0.3::DOUBLE + toxic * 0.1::DOUBLE AS confidence FROM labels JOIN documents USING (doc_id) WHERE source IS NOT NULL)""",
    "topics": f"""SELECT user_id, slug AS id, slug, label FROM (SELECT DISTINCT user_id FROM sources) JOIN (VALUES {", ".join(f"({i}, '{t[0]}', '{t[1]}')" for i, t in enumerate(fixed.TOPICS))}) t(i, slug, label) ON i <> user_id""",
    "scroll_events": """SELECT user_id, 'src' || (k % 20) || '~' || k AS item_id, ts, (event_id % 1000)::DOUBLE AS scroll_top, (800 + k * 10)::DOUBLE AS scroll_height, 800.0::DOUBLE AS client_height
      FROM (SELECT *, (props->>'$.k')::INT AS k FROM events)""",
    "call_log": "SELECT user_id::VARCHAR AS client, epoch_ms(epoch_us(ts) // 1000 // 5000) AS ts, epoch_us(ts) // 1000 // 5000 AS ms, event_id AS seq FROM events",
}
_NEEDS = {"reading": ["reading_changes"], "topics": ["sources"]}


def with_views(body: str, *names: str) -> str:
    """SQL with the named views before it."""
    order: list[str] = []
    for name in names:
        order += [n for n in (*_NEEDS.get(name, []), name) if n not in order]
    return "WITH " + ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in order) + "\n" + body
