"""Functions on a body: an array of typed blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .text import blank_to_null, collapse, half_up, minutes_for
from .urls import image_identity

_NO_BLOCKS = "array<string>"


def first_where(body: Column, test) -> Column:
    """Position (from 1) of the first block that passes, else null."""
    return F.array_position(F.transform(body, test), True).cast("int")


def is_text(b: Column) -> Column:
    return b["kind"].isin("p", "h2", "quote", "note")


def is_figure(b: Column) -> Column:
    return (b["kind"] == "figure") & b["src"].isNotNull()


def blocks_to_text(body: Column) -> Column:
    """Text of the paragraphs, white space collapsed."""
    return collapse(F.array_join(F.transform(F.filter(body, lambda b: b["kind"] == "p"), lambda b: b["text"]), " "))


def paragraph_texts(body: Column) -> Column:
    return F.filter(F.transform(F.filter(body, is_text), lambda b: collapse(b["text"])), lambda t: t != "")


def block_text(b: Column) -> Column:
    """A line that stands for one block."""
    src = F.coalesce(b["src"], F.lit("(figure)"))
    return (
        F.when(b["kind"].isin("p", "h2", "quote", "note", "code"), b["text"])
        .when(b["kind"] == "list", F.array_join(b["items"], " · "))
        .when(b["kind"] == "figure", F.when(blank_to_null(b["caption"]).isNotNull(), F.concat(src, F.lit(" — "), b["caption"])).otherwise(src))
        .when(b["kind"] == "video", F.concat(b["provider"], F.lit(":"), b["video_id"]))
        .when(b["kind"] == "rule", "—")
        .otherwise("")
    )


def reading_minutes(body: Column) -> Column:
    def of(b: Column) -> Column:
        text = F.when(b["kind"] == "list", F.array_join(b["items"], " ")).when(is_text(b) | (b["kind"] == "code"), b["text"])
        return F.coalesce(minutes_for(text), F.lit(0.0)) * F.when(b["kind"] == "code", 0.4).otherwise(1.0)

    total = F.aggregate(body, F.lit(0.0), lambda s, b: s + of(b))
    return F.greatest(F.lit(1), half_up(total)).cast("int")


def leads_with_media(body: Column) -> Column:
    """Whether a figure or video comes before any paragraph."""
    media = F.filter(body, lambda b: b["kind"].isin("figure", "video", "p"))
    return F.coalesce(F.get(media, F.lit(0))["kind"] != "p", F.lit(False))


def first_figure_src(body: Column) -> Column:
    return F.get(F.filter(body, is_figure), F.lit(0))["src"]


def strip_cover_copy(body: Column, cover: Column) -> Column:
    """The body without its first figure, if that is the cover."""
    at = F.array_position(F.transform(body, is_figure), True)
    same = image_identity(first_figure_src(body)) == image_identity(cover)
    return F.when(F.coalesce(same, F.lit(False)), F.filter(body, lambda b, i: i != at - 1)).otherwise(body)


def dedupe(body: Column) -> Column:
    """Without figures seen before and paragraphs equal to the block just before."""

    def stays(b: Column, i: Column) -> Column:
        before = F.slice(body, F.lit(1), i)
        seen = F.exists(before, lambda x: is_figure(x) & (x["src"] == b["src"]))
        last = F.get(body, i - 1)
        twin = (b["kind"] == "p") & (last["kind"] == "p") & (last["text"] == b["text"])
        return ~(F.when(is_figure(b), F.coalesce(seen, F.lit(False))).otherwise(F.coalesce(twin & (i > 0), F.lit(False))))

    return F.filter(body, stays)


def count_kinds(body: Column, *kinds: str) -> Column:
    return F.size(F.filter(body, lambda b: b["kind"].isin(*kinds)))


def story_layout(image: Column, summary: Column) -> Column:
    return F.when(F.coalesce(summary, F.lit("")) == "", "brief").when(blank_to_null(image).isNotNull(), "standard").otherwise("compact")


def repaired_content_state(state: Column, body: Column, summary: Column) -> Column:
    """A stored "full" (or no) state is "summary" where the body says no more than the summary."""
    s = collapse(F.coalesce(summary, F.lit("")))
    return F.when(state.isin("summary", "truncated"), state).when((s != "") & (blocks_to_text(body) == s), "summary").otherwise("full")


def content_state(rich: Column, cue: Column, body: Column, summary: Column, truncated: Column) -> Column:
    teaser = cue | ((summary != "") & (blocks_to_text(body) == summary))
    return F.when(truncated, "truncated").when(~rich | F.coalesce(teaser, F.lit(False)), "summary").otherwise("full")


def best_image(candidates: Column) -> Column:
    """URL of the smallest candidate (``url``, ``width``) that is wide enough, else the widest, else the first."""
    sized = F.filter(candidates, lambda c: c["width"].isNotNull())
    wide = F.filter(sized, lambda c: c["width"] >= fixed.IMAGE_WIDTH)
    by_width = lambda sign: lambda a, b: F.coalesce(F.signum((a["width"] - b["width"]) * sign).cast("int"), F.lit(0))
    first = lambda c: F.get(c, F.lit(0))["url"]
    return F.when(F.size(sized) == 0, first(candidates)).when(F.size(wide) > 0, first(F.array_sort(wide, by_width(1)))).otherwise(first(F.array_sort(sized, by_width(-1))))


def srcset_candidates(value: Column) -> Column:
    """(``url``, ``width``) of each entry of a ``srcset``; ``2x`` counts as 2000 wide."""
    parts = F.filter(F.transform(F.split(value, ","), lambda p: F.trim(p)), lambda p: p != "")

    def one(p: Column) -> Column:
        w, x = F.regexp_extract(p, r"\s(\d+)w(?:\s|$)", 1), F.regexp_extract(p, r"\s([\d.]+)x(?:\s|$)", 1)
        return F.struct(F.regexp_extract(p, r"^\S+", 0).alias("url"), F.coalesce(w.try_cast("double"), x.try_cast("double") * 1000).alias("width"))

    return F.transform(parts, one)
