"""Scalar text functions as Column expressions: hashing, labels, summaries."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed

_FNV_START, _FNV_PRIME = 2166136261, 16777619


#: ``fixed.WS`` and ``fixed.CJK`` as Java reads them fastest: most characters fail at the first of a few ranges.
_WS = rf"[\t-\r\x20\u00a0-\uffff&&{fixed.WS}]"
_CJK = rf"[\u3040-\uffff&&{fixed.CJK}]"
_WS_CHARACTERS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    # single spaces stay as they are
    return F.trim(F.regexp_replace(c, rf"{_WS}(?:{_WS}+|(?<! ))", " "))


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.trim(c, F.lit(_WS_CHARACTERS))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))


def half_up(c: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(c + 0.5)


def fnv(c: Column) -> Column:
    """FNV-1a of the text's UTF-16 units as the absolute value of a signed 32-bit number."""
    return let(c, _fnv)


def _fnv(c: Column) -> Column:
    units = F.flatten(
        F.transform(
            F.transform(F.split(c, ""), F.ascii),
            lambda p: F.when(p > 0xFFFF, F.array((F.lit(0xD800) + F.shiftright(p - 0x10000, 10)).cast("int"), (F.lit(0xDC00) + ((p - 0x10000) % 1024)).cast("int"))).otherwise(F.array(p)),
        )
    )
    step = lambda h, u: (h.bitwiseXOR(u.cast("long")) * _FNV_PRIME).bitwiseAND(F.lit(0xFFFFFFFF))
    h = F.aggregate(units, F.lit(_FNV_START).cast("long"), step)
    return F.when(c == "", F.lit(_FNV_START).cast("long")).otherwise(let(h, lambda h: F.when(h >= 2**31, F.lit(2**32) - h).otherwise(h)))


def base36(c: Column) -> Column:
    return F.lower(F.conv(c.cast("string"), 10, 36))


def fnv36(c: Column) -> Column:
    return base36(fnv(c))


def monogram(name: Column) -> Column:
    """Two letters that stand for a name."""
    return let(F.filter(F.split(F.regexp_replace(name, r"[^\p{L}\p{N} ]", " "), " +"), lambda w: w != ""), _initials)


def _initials(words: Column) -> Column:
    letter = lambda word, at: _capital(F.substring(F.get(words, F.lit(word)), at, 1))
    one, two = F.concat(letter(0, 1), letter(0, 2)), F.concat(letter(0, 1), letter(1, 1))
    return F.when(F.size(words) == 0, "··").when(F.size(words) == 1, one).otherwise(two)


def _capital(letter: Column) -> Column:
    """A letter's capital that is one letter too, where ``upper`` may give several (``ß``); the letter itself if there is none."""
    upper, title = F.upper(letter), F.initcap(letter)
    return F.when(F.length(upper) == 1, upper).when(letter == "ß", "ẞ").when(F.length(title) == 1, title).otherwise(letter)


def decode_entities(c: Column) -> Column:
    """Known named references and numeric ones, in one pass; others stay.

    A text is cut at its ampersands, so what a reference yields is never read as one.
    """
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(F.split(c, "&"), lambda part, i: F.when(i == 0, part).otherwise(_referred(part))), "")).otherwise(c)


def _referred(part: Column) -> Column:
    name = F.regexp_extract(part, fixed.REFERENCE, 1)
    given = let(name, lambda n: F.when(n.startswith("#"), _numbered(n)).otherwise(F.coalesce(_named(n), _named(F.lower(n)))))
    rest = F.substring(part, F.length(name) + 2, F.length(part))
    return F.coalesce(F.concat(F.nullif(given, F.lit("")), rest), F.concat(F.lit("&"), part))


def _named(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in fixed.ENTITIES.items() for x in pair])
    return F.try_element_at(table, name)


def _numbered(name: Column) -> Column:
    """The character of ``#123`` or ``#x1F``; null if there is none."""
    hexes = F.regexp_extract(name, "^#[xX]0*([0-9a-fA-F]{1,6})$", 1)
    digits = F.regexp_extract(name, "^#0*([0-9]{1,7})(?![0-9])", 1)
    code = F.when(hexes != "", F.conv(hexes, 16, 10)).when(digits != "", digits).cast("long")
    known = code.isNotNull() & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def html_to_text(c: Column, decode=decode_entities) -> Column:
    """Plain text of markup: block ends are blank lines, ``br`` is a line end."""
    c = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    c = F.regexp_replace(c, r"(?i)</(p|div|section|article|li|h[1-6]|blockquote|tr)\s*>", "\n\n")
    c = F.regexp_replace(c, r"(?i)<br\b[^>]*>", "\n")
    c = decode(F.regexp_replace(c, "<[^>]*>", ""))
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]{2,}|\t", " "), r"\n{3,}", "\n\n"))


def scrub_boilerplate(c: Column) -> Column:
    """Trailers such as "Read more" go; white space collapses.

    A pattern is tried only where the letters that it needs are found.
    """
    has = lambda t, *parts: reduce(or_, [F.contains(F.lower(t), F.lit(x)) for x in parts])
    for pattern, parts in ((fixed.POST_TRAILER, ["appeared"]), (fixed.MORE_TRAILER, ["read", "comment"]), (fixed.ELLIPSIS_TRAILER, ["[…]"])):
        c = let(c, lambda t: F.when(has(t, *parts), F.regexp_replace(t, pattern, " ")).otherwise(t))  # noqa: B023
    return collapse(c)


def shorten(c: Column, limit: int = 260) -> Column:
    """At most ``limit`` characters, back to the last sentence end if that lies past the middle."""
    return let(c, lambda t: F.when(F.length(t) <= limit, t).otherwise(F.concat(let(F.substring(t, 1, limit), lambda cut: _to_stop(cut, limit)), F.lit("…"))))


def _to_stop(cut: Column, limit: int) -> Column:
    # an occurrence's place from the end of the reversed text
    last = lambda mark: F.when(F.instr(cut, mark) > 0, F.length(cut) - F.length(mark if isinstance(mark, Column) else F.lit(mark)) - F.instr(F.reverse(cut), mark[::-1]) + 1).otherwise(-1)
    stop = F.greatest(*[last(mark) for mark in (". ", "! ", "? ", "。", "！", "？")])
    kept = F.when(stop > limit * 0.5, F.substring(cut, F.lit(1), (stop + 1).cast("int"))).otherwise(cut)
    return strip(kept)


def html_to_summary(c: Column, limit: int = 260, decode=decode_entities) -> Column:
    return text_to_summary(html_to_text(c, decode), limit)


def text_to_summary(text: Column, limit: int = 260) -> Column:
    return shorten(scrub_boilerplate(text), limit)


def read_more_cue(c: Column) -> Column:
    """Whether the text of markup ends like a teaser."""
    return ends_like_teaser(html_to_text(c))


def ends_like_teaser(text: Column) -> Column:
    return F.right(text, F.lit(160)).rlike(fixed.READ_MORE_CUE)


def clean_title(title: Column, *names: Column) -> Column:
    """The title without a site's name and a separator at either end; null if nothing is there."""
    seps = "[" + fixed.TITLE_SEPARATORS + "]"
    t = collapse(title)
    for name in names:
        site = collapse(name)
        n = F.length(site)
        same = lambda part: F.lower(part) == F.lower(site)  # noqa: B023, E731
        lead = same(F.left(t, n)) & F.substring(t, n + 1, F.lit(2**30)).rlike(f"^ ?{seps}")
        u = F.when(lead, F.regexp_replace(F.substring(t, n + 1, F.lit(2**30)), f"^ ?{seps} ?", "")).otherwise(t)
        rest = F.left(u, F.greatest(F.length(u) - n, F.lit(0)))
        tail = same(F.right(u, n)) & rest.rlike(f"{seps} ?$")
        v = F.trim(F.when(tail, F.regexp_replace(rest, f" ?{seps} ?$", "")).otherwise(u))
        usable = site.isNotNull() & (site != "") & (F.lower(site) != F.lower(t)) & (v != "")
        t = F.when(usable, v).otherwise(t)
    return blank_to_null(t)


def slug(label: Column) -> Column:
    """A topic's slug before it is told apart from others."""
    s = F.regexp_replace(F.lower(label), "[^a-z0-9]+", "-")
    s = F.left(F.regexp_replace(s, "^-+|-+$", ""), F.lit(40))
    return F.when(s == "", "topic").otherwise(s)


def fingerprint(title: Column, summary: Column) -> Column:
    return fnv36(F.concat(F.lower(collapse(title)), F.lit("\u0000"), F.lower(collapse(summary))))


def ago_label(minutes: Column) -> Column:
    day = fixed.TODAY_MINUTES
    plural = lambda n, one, many: F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many), F.lit(" ago"))
    hours, days = half_up(minutes / 60), half_up(minutes / day)
    return (
        F.when(minutes < 60, F.concat(F.greatest(F.lit(1), half_up(minutes)).cast("string"), F.lit(" min ago")))
        .when(minutes < day, plural(hours, "hr", "hrs"))
        .when(days == 1, "yesterday")
        .when(days < 7, F.concat(days.cast("string"), F.lit(" days ago")))
        .when(days < 365, plural(half_up(days / 7), "week", "weeks"))
        .otherwise(plural(F.floor(days / 365), "year", "years"))
    )


def published_label(ts: Column) -> Column:
    return F.date_format(ts, "d MMMM yyyy")


def parse_date(c: Column) -> Column:
    """RFC-822 or ISO dates; null where it is neither."""
    bare = F.regexp_replace(strip(c), r"^[A-Za-z]{3},\s*", "")
    zone = F.regexp_replace(bare, r" (UT|UTC|GMT|Z)$", " +0000")
    iso = F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(bare))
    patterns = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss", "d MMM yyyy"]
    return F.coalesce(iso, *[F.try_to_timestamp(zone, F.lit(p)) for p in patterns])


def minutes_for(text: Column) -> Column:
    """Reading time of a text in minutes, as a fraction."""
    # by lengths, as counts of matches hold them all in an array
    cjk = F.length(text) - F.length(F.regexp_replace(text, _CJK, ""))
    words = let(collapse(F.regexp_replace(text, _CJK, " ")), lambda t: F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1))
    return cjk / fixed.CJK_PER_MINUTE + words / fixed.WORDS_PER_MINUTE


def clamp01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def scroll_progress(top: Column, height: Column, client: Column) -> Column:
    room = height - client
    return F.when(room <= 8, F.lit(0.0)).otherwise(clamp01(top / room))


def read_signal(top: Column, height: Column, client: Column) -> Column:
    room = height - client
    return F.when(room < fixed.SCROLL_LEAST, "dwell").when(top >= room - fixed.END_TOLERANCE, "now").otherwise("none")
