"""Refreshing feeds and articles: what is due, reconciling with the cache, source upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import blocks, urls
from ..functions.text import blank_to_null, clean_title, strip
from ..sources.shared import broadcast_if_small, stored


def _age_ms(ts: Column, as_of: Column) -> Column:
    return F.unix_millis(as_of) - F.coalesce(F.unix_millis(ts), F.lit(0))


def article_refresh_due(as_of: Column) -> Column:
    """Whether an article's page should be read again."""
    age, hour = _age_ms(F.col("content_checked_at"), as_of), 3_600_000
    return (
        F.when(F.col("link").isNull() | (F.col("link") == ""), False)
        .when(~F.col("extractor_version").eqNullSafe(F.lit(fixed.EXTRACTOR_VERSION)), True)
        .when((F.col("extraction_state") == "failed") & (age < fixed.RETRY_HOURS * hour), False)
        .when(F.col("content_fetched_at").isNotNull(), age >= fixed.ARTICLE_STALE_HOURS * hour)
        .otherwise(True)
    )


def sources_stale(sources: DataFrame, as_of: Column, attempts: DataFrame | None = None, forced: bool = False) -> DataFrame:
    """Live sources whose last fetch (and last attempt) is half an hour old; all live ones if forced."""
    live = sources.where("deleted_at IS NULL")
    if forced:
        return live
    limit = fixed.STALE_MINUTES * 60_000
    stale = live.where(_age_ms(F.col("fetched_at"), as_of) >= limit)
    if attempts is None:
        return stale
    last = attempts.groupBy("user_id", "id").agg(F.max("attempted_at").alias("attempted_at"))
    stale = stale.join(last, ["user_id", "id"], "left")
    return stale.where(F.col("attempted_at").isNull() | (_age_ms(F.col("attempted_at"), as_of) >= limit)).drop("attempted_at")


def sweep(stale: DataFrame) -> DataFrame:
    """The order in which each reader's stale sources are read: those fetched longest ago first (``rank``)."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("fetched_at").asc_nulls_first(), "id"))
    return stale.withColumn("rank", rank)


def reconcile(items: DataFrame, cached: DataFrame, at: Column) -> DataFrame:
    """Article rows for the incoming ``items`` (with ``source_id``) of refreshed sources.

    An article whose page was read keeps all but what the feed alone knows.
    ``rebuilt`` tells the others.  Both sides are joined on source and id, so a
    table bucketed by source needs no exchange.
    """
    i = items.withColumn("article_id", F.concat_ws("~", "source_id", "id")).select(F.col("source_id").alias("sid"), "article_id", F.struct(*[c for c in items.columns if c not in ("id", "source_id")]).alias("i"))
    c = cached.select("source_id", "id", F.struct(*cached.columns).alias("c"))
    both = i.join(c, (F.col("sid") == F.col("source_id")) & (F.col("article_id") == F.col("id")), "left")
    keep = F.col("c.content_fetched_at").isNotNull() | F.coalesce(F.col("c.extraction_state") == "success", F.lit(False))
    failed = F.coalesce(F.col("c.extraction_state") == "failed", F.lit(False)) & (F.col("i.content_state") != "full")
    fresh = {
        "id": F.col("article_id"),
        "source_id": F.col("sid"),
        "published_at": F.coalesce("i.published_at", "c.published_at", at),
        "extraction_state": F.when(failed, "failed").otherwise("idle"),
        "content_checked_at": F.when(failed, F.col("c.content_checked_at")),
    }
    kept = {
        "link": F.coalesce("i.link", "c.link"),
        "summary": F.coalesce(blank_to_null(F.col("i.summary")), F.col("c.summary")),
        "image_caption": F.coalesce("i.image_caption", "c.image_caption"),
    }
    from_item = {f.name for f in both.schema["i"].dataType.fields}
    out = []
    for field in cached.schema.fields:
        name = field.name
        if name == "fetched_at":
            out.append(at.alias(name))
            continue
        new = fresh.get(name, F.col(f"i.{name}") if name in from_item else F.lit(None).cast(field.dataType))
        out.append(F.when(keep, kept.get(name, F.col(f"c.{name}"))).otherwise(new).alias(name))
    return both.select(*out, (~keep).alias("rebuilt"))


#: Fields that a rebuilt row does not have.
_NOT_REBUILT = {"video_page", "content_fetched_at", "etag", "last_modified", "extractor_version"}


def feed_changed(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """(``source_id``, ``changed``) for the sources in ``fresh`` (rows of ``reconcile``).

    Bodies are compared by digests, so they don't travel; ``fetched_at`` doesn't count.
    """
    fresh = stored(slim(fresh))  # read for its sources and for its rows
    cached = slim(cached).join(fresh.select("source_id").distinct(), "source_id", "left_semi")
    return _changed(cached, fresh)


def _changed(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """``feed_changed`` of slim rows, those of the sources in ``fresh``."""
    names = [c for c in cached.columns if c not in ("id", "source_id", "fetched_at")]
    a, b = (t.select("source_id", "id", F.struct(*names, *more).alias(n)) for t, n, more in ((cached, "a", []), (fresh, "b", ["rebuilt"])))
    same = F.lit(True)
    for c in names:
        equal = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        same = same & (equal | F.col("b.rebuilt") if c in _NOT_REBUILT else equal)
    j = a.join(b, ["source_id", "id"], "full_outer")
    return j.groupBy("source_id").agg(F.bool_or(F.col("a").isNull() | F.col("b").isNull() | ~same).alias("changed"))


def slim(rows: DataFrame) -> DataFrame:
    """Rows with a digest in place of their bodies; nulls and empty fields count as different."""
    return rows.withColumn("body", F.when(F.col("body").isNotNull(), F.xxhash64(F.to_json(F.struct("body")))))


def refresh_changes(items: DataFrame, cached: DataFrame, at: Column, narrow: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What a refresh changes: the article rows of the sources that changed, and (``source_id``, ``changed``) of all in ``items``.

    ``items`` should be cheap to read again; ``narrow`` are their ``slim`` rows, where these are there already.
    Rows are reconciled and compared without bodies, which are fetched at the end, by the ids of changed
    sources alone and from the side that counts: an unchanged feed moves no body.
    """
    narrow = stored(slim(items)) if narrow is None else narrow
    mine = broadcast_if_small(stored(narrow.select("source_id").distinct()))
    known = stored(slim(cached.join(mine, "source_id", "left_semi")))
    fresh = stored(reconcile(narrow, known, at))
    verdicts = stored(_changed(known, fresh))
    changed = broadcast_if_small(stored(verdicts.where("changed").select("source_id")))
    rows = stored(fresh.join(changed, "source_id", "left_semi"))
    ids = lambda own: broadcast_if_small(rows.where(F.col("rebuilt") == own).select("source_id", F.col("id").alias("of")))
    new = items.select("source_id", F.concat_ws("~", "source_id", "id").alias("of"), "body").join(ids(True), ["source_id", "of"], "left_semi")
    old = cached.select("source_id", F.col("id").alias("of"), "body").join(ids(False), ["source_id", "of"], "left_semi")
    bodies = new.withColumn("own", F.lit(True)).unionByName(old.withColumn("own", F.lit(False))).withColumnRenamed("source_id", "sid")
    with_body = rows.drop("body").join(bodies, (F.col("source_id") == F.col("sid")) & (F.col("id") == F.col("of")) & (F.col("rebuilt") == F.col("own")))
    return with_body.select(*cached.columns), verdicts


def source_edit(sources: DataFrame, edits: DataFrame, at: Column) -> DataFrame:
    """``edits``: (``user_id``, ``id``, ``title``, ``folder``, ``unfile``, ``url``); null or blank leaves a field."""
    e = edits.select("user_id", "id", F.struct("title", "folder", "unfile", "url").alias("e"))
    s = sources.join(e, ["user_id", "id"], "left")
    url = blank_to_null(strip(F.col("e.url")))
    new = {
        "title": F.coalesce(blank_to_null(strip(F.col("e.title"))), "title"),
        "folder": F.when(F.col("e.unfile"), F.lit(None)).otherwise(F.coalesce("e.folder", "folder")),
        "url": F.coalesce(url, "url"),
        "host": F.when(url.isNotNull(), urls.host_of(url)).otherwise(F.col("host")),
        "updated_at": F.when(F.col("e").isNotNull(), at).otherwise(F.col("updated_at")),
    }
    return s.select(*[new.get(c, F.col(c)).alias(c) for c in sources.columns])


def source_refresh_log(sources: DataFrame, outcomes: DataFrame, at: Column) -> DataFrame:
    """``outcomes``: (``user_id``, ``id``, ``ok``, ``site_url``, ``error``).  Success moves the fetch time and clears the error."""
    o = outcomes.select("user_id", "id", F.struct("ok", F.col("site_url").alias("site"), F.col("error").alias("why")).alias("o"))
    s = sources.join(o, ["user_id", "id"], "left")
    ok, hit = F.coalesce("o.ok", F.lit(False)), F.col("o").isNotNull()
    new = {
        "site_url": F.when(ok, F.coalesce("o.site", "site_url")).otherwise(F.col("site_url")),
        "host": F.when(ok, urls.host_of(F.coalesce("o.site", "site_url"))).otherwise(F.col("host")),
        "fetched_at": F.when(ok, at).otherwise(F.col("fetched_at")),
        "error": F.when(ok, F.lit(None)).when(hit, F.col("o.why")).otherwise(F.col("error")),
        "updated_at": F.when(hit, at).otherwise(F.col("updated_at")),
    }
    return s.select(*[new.get(c, F.col(c)).alias(c) for c in sources.columns])


def apply_extraction(articles: DataFrame, outcomes: DataFrame, at: Column) -> DataFrame:
    """Articles after their pages were read.

    ``outcomes``: (``link``, ``outcome`` ok, not_modified or failed, ``title``,
    ``author``, ``body``, ``truncated``, ``image``, ``has_cover``, ``video_page``,
    ``etag``, ``last_modified``), one row a link.
    """
    fields = ["outcome", "title", "author", "body", "truncated", "image", "has_cover", "video_page", "etag", "last_modified"]
    o = outcomes.select("link", F.struct(*fields).alias("o"))
    a = articles.join(o, "link", "left")
    ok, same, failed = (F.coalesce(F.col("o.outcome") == x, F.lit(False)) for x in ("ok", "not_modified", "failed"))
    original = F.col("content_fetched_at").isNotNull() | F.coalesce(F.col("extraction_state") == "success", F.lit(False))
    on_ok = {
        "title": F.coalesce(blank_to_null(F.col("o.title")), "title"),
        "author": F.coalesce(blank_to_null(F.col("o.author")), "author"),
        "body": F.col("o.body"),
        "image": F.coalesce("o.image", "image"),
        "has_cover": F.coalesce("o.has_cover", "has_cover"),
        "video_page": F.coalesce("o.video_page", "video_page"),
        "etag": F.coalesce("o.etag", "etag"),
        "last_modified": F.coalesce("o.last_modified", "last_modified"),
        "minutes": blocks.reading_minutes(F.col("o.body")),
        "content_state": F.when(F.col("o.truncated"), "truncated").otherwise("full"),
        "extraction_state": F.lit("success"),
        "content_fetched_at": at,
        "content_checked_at": at,
        "extractor_version": F.lit(fixed.EXTRACTOR_VERSION),
    }
    on_failed = {
        "extraction_state": F.when(original, F.col("extraction_state")).otherwise("failed"),
        "content_checked_at": at,
        "extractor_version": F.lit(fixed.EXTRACTOR_VERSION),
    }

    def field(name: str) -> Column:
        c = F.col(name)
        value = F.when(ok, on_ok.get(name, c)).when(failed, on_failed.get(name, c))
        return (value.when(same, at) if name == "content_checked_at" else value).otherwise(c).alias(name)

    return a.select(*[field(f.name) for f in articles.schema.fields])


def folder_suggest(sources: DataFrame, answers: DataFrame) -> DataFrame:
    """Sources with the folder that a decision suggests, where it is sure and the reader has none."""
    a = answers.select("user_id", "id", "slug", "confidence")
    s = sources.join(a, ["user_id", "id"], "left")
    folder = F.coalesce("folder", F.when(F.col("confidence") >= fixed.CONFIDENCE, F.col("slug")))
    return s.select(*[folder.alias(c) if c == "folder" else F.col(c) for c in sources.columns])


__all__ = ["apply_extraction", "article_refresh_due", "clean_title", "feed_changed", "folder_suggest", "reconcile", "refresh_changes", "source_edit", "source_refresh_log", "sources_stale", "sweep"]
