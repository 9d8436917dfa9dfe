"""Articles from pages, and the comparison of two extractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import blocks as bl
from ..functions import html as hx
from ..functions import text as tx


def page_meta(html: Column, name: str) -> Column:
    """A ``meta`` element's content, by property or name."""
    tag = F.regexp_extract(html, rf"(?i)<meta\b[^>]*(?:property|name)=[\"']{name}[\"'][^>]*>", 0)
    return tx.blank_to_null(tx.decode_entities(F.regexp_extract(tag, r"(?i)\bcontent=[\"']([^\"']*)[\"']", 1)))


def within_size(body: Column, most: int = fixed.MAX_BYTES) -> Column:
    return F.octet_length(body) <= most


def extract(pages: DataFrame, hint: Column | None = None) -> DataFrame:
    """One row per page (``url``, ``html``): the article, or an ``error``.

    Oversized pages are refused before any markup is read.
    """
    p = pages.withColumn("html", F.when(within_size(F.col("html")), F.col("html")))
    # read once: the helper's struct is computed in a row of its own
    p = p.select("url", F.col("html").isNull().alias("refused"), (hint if hint is not None else F.lit(None).cast("string")).alias("hint"), hx.read_page(F.col("html"), F.col("url")).alias("x"))
    video = F.col("x.video").isNotNull()
    excused = video | F.col("x.video_page")
    unreadable = (F.size("x.blocks") == 0) | (F.length("x.text") < fixed.MIN_ARTICLE_CHARS)
    error = F.when(F.col("refused"), "too large or missing").when(unreadable & ~excused, "no readable article")
    clip = F.array(F.struct(*[(F.lit("video") if n == "kind" else F.col(f"x.video.{n}") if n in ("provider", "video_id", "title") else F.lit(None)).alias(n) for n in ("kind", "text", "cite", "inline", "items", "inline_items", "src", "caption", "seed", "provider", "video_id", "title")]))
    p = p.withColumn("error", error).withColumn("body", F.when(video, F.concat(clip.cast(p.schema["x"].dataType["blocks"].dataType), F.col("x.blocks"))).otherwise(F.col("x.blocks")))
    cover = F.col("x.image").isNotNull() & ~bl.leads_with_media(F.col("body"))
    return p.select(
        "url",
        "error",
        tx.clean_title(F.col("x.title"), F.col("x.site"), F.col("hint")).alias("title"),
        tx.blank_to_null(tx.strip(F.col("x.author"))).alias("author"),
        F.col("x.published").alias("published_time"),
        F.col("x.site").alias("site_name"),
        F.when(cover, bl.strip_cover_copy(F.col("body"), F.col("x.image"))).otherwise(F.col("body")).alias("body"),
        F.col("x.truncated").alias("truncated"),
        F.coalesce("x.image", bl.first_figure_src(F.col("x.blocks"))).alias("image"),
        cover.alias("has_cover"),
        F.col("x.video_page").alias("video_page"),
        F.length("x.text").alias("text_length"),
    )


def html_pages(pages: DataFrame) -> DataFrame:
    """The pages (``url``, ``html``) that are HTML, by their type where it is known, else by their root element."""
    if "content_type" in pages.columns:
        return pages.where(F.col("content_type").ilike("%html%"))
    return pages.where(F.col("html").ilike("%<html%"))


def distinct_links(html: Column) -> Column:
    """The addresses that a page's anchors link to, each once, in the order of their first occurrence."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'<a\b[^>]*href="([^"]*)"'), F.lit(1)))


def extraction_stats(extracted: DataFrame) -> DataFrame:
    return extracted.select("url", "text_length", bl.count_kinds(F.col("body"), "figure", "video").alias("media"), F.size("body").alias("blocks"), "truncated")


def paragraph_diff(a: DataFrame, b: DataFrame, key: str = "url") -> DataFrame:
    """Lines of two extractions (``key``, ``body``): a's in order as same or onlyA, then those that only b has.

    Lines are matched within their page by text, side by side, so a repeated line
    makes no product.
    """
    lines = lambda t, side: t.select(key, F.lit(side).alias("side"), F.posexplode(bl.paragraph_texts(F.col("body"))).alias("pos", "text"))
    # both are read once: the lines of a page with one text meet in a window
    both = Window.partitionBy(key, "text")
    rows = lines(a, 0).unionByName(lines(b, 1))
    named = F.col(key).isNotNull()
    rows = rows.withColumn("in_a", named & (F.min("side").over(both) == 0)).withColumn("in_b", named & (F.max("side").over(both) == 1))
    kind = F.when(F.col("side") == 1, "onlyB").when(F.col("in_b"), "same").otherwise("onlyA")
    return rows.where((F.col("side") == 0) | ~F.col("in_a")).select(key, "side", "pos", kind.alias("kind"), "text")


def paragraph_diff_counts(diff: DataFrame, key: str = "url") -> DataFrame:
    return diff.groupBy(key).agg(*[F.count_if(F.col("kind") == k).alias(name) for k, name in (("same", "same"), ("onlyA", "only_a"), ("onlyB", "only_b"))])
