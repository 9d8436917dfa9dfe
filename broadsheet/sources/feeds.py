"""Feed documents (RSS 2.0, Atom, RDF) to one item table.

The XML is read by Spark's own ``from_xml`` with one schema a dialect, on the
executors, a document a row; no document is held by the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import blocks as bl
from ..functions import html as hx
from ..functions import text as tx
from ..functions import urls
from ..operators import state as st
from . import xml

_NODE = "ARRAY<STRUCT<_VALUE: STRING, _href: STRING, _rel: STRING, _type: STRING, _url: STRING, name: STRING>>"
_TEXTS = ["title", "guid", "id", "description", "summary", "content", "`content:encoded`", "`dc:creator`", "`itunes:author`", "author", "`atom:author`", "pubDate", "published", "updated", "`dc:date`", "date"]
_MEDIA = ["link", "`media:content`", "`media:thumbnail`", "`itunes:image`", "image", "enclosure", "`media:description`", "`media:credit`"]
_ITEM = "ARRAY<STRUCT<" + ", ".join(f"{n}: {_NODE}" for n in [*_TEXTS, *_MEDIA]) + ", `_rdf:about`: STRING>>"
_HEAD = ", ".join(f"{n} {_NODE}" for n in ["title", "link", "description", "subtitle", "tagline", "`dc:creator`", "`itunes:author`", "author", "`atom:author`"])
_HEAD_IN = ", ".join(f"{n}: {_NODE}" for n in ["title", "link", "description", "subtitle", "tagline", "`dc:creator`", "`itunes:author`", "author", "`atom:author`"])

#: Where ``from_xml`` puts what it can't read.
_CORRUPT = "_corrupt_record"
SCHEMAS = {
    "atom": f"{_HEAD}, entry {_ITEM}, {_CORRUPT} STRING",
    "rdf": f"channel STRUCT<{_HEAD_IN}>, item {_ITEM}, {_CORRUPT} STRING",
    "rss": f"channel STRUCT<{_HEAD_IN}, item: {_ITEM}>, {_CORRUPT} STRING",
}
_OPTIONS = {"attributePrefix": "_", "valueTag": "_VALUE", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}


def first_text(node: Column) -> Column:
    """The first element's text that isn't blank, else an empty string."""
    texts = F.filter(F.transform(node, lambda n: tx.strip(n["_VALUE"])), lambda t: t.isNotNull() & (t != ""))
    return F.coalesce(F.get(texts, F.lit(0)), F.lit(""))


def _first(node: Column, field: str) -> Column:
    found = F.filter(F.transform(node, lambda n: tx.strip(n[field])), lambda t: t.isNotNull() & (t != ""))
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def best_link(links: Column, base: Column) -> Column:
    """The address that best is a document's own: alternate before others before self, HTML first."""
    scored = F.transform(
        links,
        lambda n, i: F.struct(
            (
                F.when(n["_href"].isNull() & n["_rel"].isNull() & n["_type"].isNull(), 1)
                .when(F.coalesce(n["_rel"], F.lit("alternate")) == "alternate", 3)
                .when(n["_rel"] == "self", 0)
                .otherwise(1)
                + F.coalesce(n["_type"].contains("html"), F.lit(False)).cast("int")
            ).alias("score"),
            (-i).alias("place"),
            urls.resolve_common(F.coalesce(n["_href"], n["_VALUE"]), base).alias("href"),
        ),
    )
    return F.array_max(F.filter(scored, lambda s: s["href"].isNotNull()))["href"]


def _or(*texts: Column) -> Column:
    """The first that isn't empty, else an empty string."""
    return F.coalesce(*[tx.blank_to_null(t) for t in texts], F.lit(""))


def _once(df: DataFrame) -> DataFrame:
    """``df`` behind a generator, so that its columns are computed once and not again wherever they are named.

    ``feed_url`` passes by it, so that rows dealt out by it need not be dealt again.
    """
    rest = [c for c in df.columns if c != "feed_url"]
    return df.select("feed_url", F.explode(F.array(F.struct(*rest))).alias("r")).select("feed_url", "r.*")


def feed_kind(body: Column) -> Column:
    """The dialect by its root element."""
    root = F.regexp_extract(F.regexp_replace(body, r"(?s)<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>", ""), r"<\s*([A-Za-z:]+)", 1)
    return F.when(root == "feed", "atom").when(F.lower(root) == "rdf:rdf", "rdf").when(root == "rss", "rss")


def parse(documents: DataFrame) -> DataFrame:
    """One row per feed: ``feed_url``, ``kind``, ``title``, ``site_url``, ``description``, ``channel_author``, raw ``items`` (40 at most) or an ``error``.

    Documents needn't be strict XML (``xml.readable``).  Markup inside a text element stays
    with its text.
    """
    # parsing costs far more than its bytes tell, so documents are spread whatever their size
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    documents = documents.repartition(parts, "feed_url")
    d = documents.withColumn("error", F.when(F.octet_length("body") > fixed.MAX_BYTES, "too large").when(~urls.looks_like_feed(F.col("body"), F.col("content_type")), "not a feed"))
    d = d.withColumn("kind", F.when(F.col("error").isNull(), feed_kind(F.col("body"))))
    d = _once(d.select("feed_url", "error", "kind", F.when(F.col("kind").isNotNull(), xml.readable(F.col("body"))).alias("body")))
    parsed = {k: F.when(F.col("kind") == k, F.from_xml("body", s, _OPTIONS)) for k, s in SCHEMAS.items()}
    d = _once(d.select("feed_url", "error", "kind", *[c.alias(k) for k, c in parsed.items()]))
    broken = F.coalesce(*[F.col(f"{k}.{_CORRUPT}") for k in SCHEMAS]).isNotNull()
    head = lambda n: F.when(F.col("kind") == "atom", F.col(f"atom.{n}")).when(F.col("kind") == "rdf", F.col(f"rdf.channel.{n}")).otherwise(F.col(f"rss.channel.{n}"))
    items = F.when(F.col("kind") == "atom", F.col("atom.entry")).when(F.col("kind") == "rdf", F.col("rdf.item")).otherwise(F.col("rss.channel.item"))
    site = F.coalesce(best_link(head("link"), F.col("feed_url")), "feed_url")
    title = _or(tx.html_to_text(first_text(head("title"))), urls.host_of(F.col("feed_url")))
    author = _or(first_text(head("`dc:creator`")), first_text(head("`itunes:author`")), _first(head("author"), "name"), first_text(head("author")), _first(head("`atom:author`"), "name"))
    about = tx.html_to_text(_or(first_text(head("description")), first_text(head("subtitle")), first_text(head("tagline"))))
    items = F.slice(F.coalesce(items, F.array().cast(d.schema["atom"].dataType["entry"].dataType)), 1, fixed.FEED_ITEMS)
    error = F.coalesce("error", F.when(F.col("kind").isNull(), "no feed found"), F.when((F.size(items) == 0) & broken, "not valid XML"), F.when(F.size(items) == 0, "no readable entries"))
    return d.select("feed_url", error.alias("error"), "kind", F.left(title, F.lit(120)).alias("title"), site.alias("site_url"), about.alias("description"), author.alias("channel_author"), items.alias("items"))


def errors(parsed: DataFrame) -> DataFrame:
    """(``feed_url``, ``error``): the documents that gave no feed, each with its reason."""
    return parsed.where("error IS NOT NULL").select("feed_url", "error")


def items(parsed: DataFrame, most: int | None = None) -> DataFrame:
    """The item table of the feeds that ``parse`` read, with bodies as blocks and shared openings stripped; with ``most``, each feed's first ones."""
    p = _once(parsed.where("error IS NULL").select("feed_url", "site_url", "channel_author", "items"))
    p = p.select("feed_url", "site_url", "channel_author", F.posexplode("items").alias("pos", "x"))
    p = p.withColumn("given", F.struct(*[first_text(F.col(f"x.{n}")).alias(n.strip("`")) for n in _TEXTS]))
    p = _once(p)
    x = lambda n: F.col(f"x.{n}")
    g = lambda n: F.col(f"given.{n}")
    rich = _or(g("`content:encoded`"), g("content"))
    plain = _or(g("description"), g("summary"))
    link = F.coalesce(best_link(x("link"), F.col("site_url")), urls.resolve_common(g("guid"), F.col("site_url")))
    author = _or(g("`dc:creator`"), g("`itunes:author`"), g("author"), g("`atom:author`"), _first(x("author"), "name"), F.col("channel_author"))
    dates = [tx.parse_date(g(n)) for n in ("pubDate", "published", "updated", "`dc:date`", "date")]
    pictures = F.transform(F.filter(x("enclosure"), lambda e: F.coalesce(e["_type"].startswith("image/"), F.lit(False)) | F.coalesce(e["_url"].rlike(fixed.IMAGE_FILE), F.lit(False))), lambda e: e["_url"])
    declared = F.concat(F.array(_first(x("`media:content`"), "_url"), _first(x("`media:thumbnail`"), "_url"), _first(x("`itunes:image`"), "_href"), _first(x("image"), "_href")), F.coalesce(pictures, F.array().cast("array<string>")))
    declared = F.get(F.filter(F.transform(declared, lambda u: urls.resolve_common(u, F.col("site_url"))), lambda u: u.isNotNull()), F.lit(0))
    caption = F.array_join(F.filter(F.array(first_text(x("`media:description`")), first_text(x("`media:credit`"))), lambda t: t != ""), " — ")
    p = p.select(
        "feed_url",
        "pos",
        "site_url",
        F.left(tx.html_to_text(g("title")), F.lit(300)).alias("title"),
        link.alias("link"),
        F.left(tx.html_to_text(author), F.lit(120)).alias("author"),
        F.coalesce(*dates).alias("published_at"),
        (rich != "").alias("rich"),
        _or(rich, plain).alias("html"),
        _or(plain, rich).alias("teaser"),
        declared.alias("declared"),
        tx.blank_to_null(caption).alias("image_caption"),
        _or(g("guid"), g("id"), F.coalesce(tx.strip(x("`_rdf:about`")), F.lit(""))).alias("publisher_id"),
    )
    p = _once(p).where("title <> '' OR html <> ''")
    # markup is read once for all that is made of its text, and not where nothing of it is asked for
    p = p.withColumn("plain", tx.html_to_text(F.col("html")))
    teaser = F.when(F.col("teaser") == F.col("html"), F.col("plain")).otherwise(tx.html_to_text(F.col("teaser")))
    p = p.withColumn("dek", tx.text_to_summary(teaser)).drop("teaser")
    p = strip_shared_opening(p.withColumn("summary", _or(F.col("dek"), F.left("plain", F.lit(220)))))
    if most is not None:  # after the openings, which all items share
        p = st.item_cap(p, most, "feed_url")
    p = p.withColumn("b", hx.html_blocks(F.col("html"), F.col("site_url")))
    body = F.col("b.blocks")
    state = bl.content_state(F.col("rich"), tx.ends_like_teaser(F.col("plain")), body, F.col("dek"), F.col("b.truncated"))
    cover = F.col("declared").isNotNull() & ~bl.leads_with_media(body)
    when = F.coalesce(F.unix_millis("published_at").cast("string"), F.lit(""))
    titled = F.when(F.col("title") != "", F.trim(F.concat_ws(" ", "title", when))).otherwise("")
    identity = _or(F.col("publisher_id"), F.col("link"), titled, F.left(tx.collapse(F.col("plain")), F.lit(400)), F.concat(F.lit("content-"), tx.fnv36(F.col("html"))))
    image = F.coalesce("declared", bl.first_figure_src(body))
    p = p.select(
        "feed_url",
        F.col("pos").cast("int").alias("pos"),
        identity.alias("identity"),
        tx.fnv36(identity).alias("id"),
        _or(F.col("title"), F.lit("Untitled")).alias("title"),
        "link",
        tx.blank_to_null(F.col("author")).alias("author"),
        "published_at",
        "summary",
        F.when(cover, bl.strip_cover_copy(body, F.col("declared"))).otherwise(body).alias("body"),
        image.alias("image"),
        cover.alias("has_cover"),
        "image_caption",
        state.alias("content_state"),
    )
    return p.withColumn("minutes", bl.reading_minutes(F.col("body"))).withColumn("layout", bl.story_layout(F.col("image"), F.col("summary")))


def common_prefix(a: Column, b: Column) -> Column:
    n = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(a), F.length(b)))), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))) & (F.length(a) >= i) & (F.length(b) >= i), i).otherwise(n))
    return F.left(a, n)


def opening_of(lowest: Column, highest: Column, n: Column) -> Column:
    """What all texts between the lowest and the highest begin with, back to a sentence end; empty if short."""
    # most differ within the least length
    begins = lambda c: F.left(c, F.lit(fixed.OPENING_LEAST))
    return F.when((n >= 3) & (begins(lowest) == begins(highest)), tx.let(common_prefix(lowest, highest), lambda prefix: _opening(prefix, n))).otherwise("")


def _opening(prefix: Column, n: Column) -> Column:
    ends = F.regexp_extract(prefix, r"(?s)^(.*(?:[。！？；]|[.!?;](?= )))", 1)
    cut = F.when(ends != "", ends).otherwise(prefix)
    return F.when((n >= 3) & (F.length(tx.strip(cut)) >= fixed.OPENING_LEAST), cut).otherwise("")


def shared_openings(items: DataFrame, group: str = "feed_url") -> DataFrame:
    """(``feed_url``, ``opening``): the longest prefix of a set is that of its least and greatest member, so the aggregate is partial."""
    given = items.where(F.col("summary") != "")
    g = given.groupBy(group).agg(F.min("summary").alias("low"), F.max("summary").alias("high"), F.count(F.lit(1)).alias("n"))
    return g.select(group, opening_of(F.col("low"), F.col("high"), F.col("n")).alias("opening"))


def strip_shared_opening(items: DataFrame, group: str = "feed_url") -> DataFrame:
    """``items`` whose summaries lack their group's opening.  They are read once, and a group (a feed has few items) meets in one task."""
    w, given = Window.partitionBy(group), F.when(F.col("summary") != "", F.col("summary"))
    j = items.withColumns({"low": F.min(given).over(w), "high": F.max(given).over(w), "n": F.count(given).over(w)})
    j = j.withColumn("opening", opening_of(F.col("low"), F.col("high"), F.col("n"))).drop("low", "high", "n")
    rest = tx.strip(F.substring("summary", F.length("opening") + 1, F.length("summary")))
    return j.withColumn("summary", F.when((F.col("opening") != "") & F.col("summary").startswith(F.col("opening")), rest).otherwise(F.col("summary"))).drop("opening")


def preview(items: DataFrame) -> DataFrame:
    """Each feed's first items, without bodies, and how many it has."""
    w = Window.partitionBy("feed_url")
    s = items.select("feed_url", "pos", "id", "title", "link")
    s = s.withColumn("n_items", F.count(F.lit(1)).over(w)).withColumn("rank", F.row_number().over(w.orderBy("pos")))
    return s.where(F.col("rank") <= fixed.PREVIEW_ITEMS)


def discover(pages: DataFrame) -> DataFrame:
    """(``url``, ``rank``, ``href``, ``title``) of the first three feeds that each page links to; rows of one address are pages of their own."""
    attr = lambda tag, name: F.coalesce(*[tx.blank_to_null(F.regexp_extract(tag, rf"(?i)\b{name}\s*=\s*{form}", 1)) for form in ('"([^"]*)"', "'([^']*)'", "([^\\s\"'>]+)")])
    links = F.transform(
        F.regexp_extract_all("html", F.lit(r"(?i)(<link\b[^>]*>)"), F.lit(1)),
        lambda tag: F.struct(
            F.lower(attr(tag, "type")).alias("type"),
            F.lower(attr(tag, "rel")).alias("rel"),
            urls.resolve_common(attr(tag, "href"), F.col("url")).alias("href"),
            F.coalesce(attr(tag, "title"), F.lit("")).alias("title"),
        ),
    )

    def is_feed(x: Column) -> Column:
        known = F.lit(False)
        for t in fixed.FEED_TYPES:
            known = known | x["type"].contains(t)
        return F.coalesce(known, F.lit(False)) & (x["rel"].isNull() | x["rel"].contains("alternate") | x["rel"].contains("feed")) & x["href"].isNotNull()

    found = lambda x: F.struct(x["href"].alias("href"), x["title"].alias("title"))
    add = lambda seen, x: F.when((F.size(seen) >= 3) | F.exists(seen, lambda y: y["href"] == x["href"]), seen).otherwise(F.array_append(seen, found(x)))
    first = F.aggregate(F.filter(links, is_feed), F.array().cast("array<struct<href: string, title: string>>"), add)
    return pages.select("url", F.posexplode(first).alias("pos", "x")).select("url", (F.col("pos") + 1).alias("rank"), "x.href", "x.title")
