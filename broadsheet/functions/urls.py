"""Predicates and functions on URLs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .text import let, strip


def normalize_feed_url(raw: Column) -> Column:
    """An http(s) address, with ``https://`` before a bare one; null if it is none."""
    t = strip(raw)
    u = F.when(t.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), t).otherwise(F.concat(F.lit("https://"), t))
    host = F.try_parse_url(u, F.lit("HOST"))
    return F.when((t != "") & u.rlike("(?i)^https?://") & host.isNotNull(), u)


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", ""), url)


def is_safe_http(url: Column) -> Column:
    t = strip(url)
    return F.coalesce(t.startswith("//") | t.rlike("(?i)^https?://"), F.lit(False))


def resolve_common(raw: Column, base: Column) -> Column:
    """``raw`` against ``base`` as an absolute http(s) address, or null."""
    return let(strip(raw), lambda t: _resolved(t, base))


def _plain_path(url: Column) -> Column:
    """The address with the ``.`` and ``..`` of its path taken."""
    parts = F.regexp_extract(url, "(?s)^(https?://[^/?#]*)(/[^?#]*)?(.*)$", 2)

    def walk(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.array_append(done, part))

    segments = F.split(F.substring(parts, F.lit(2), F.length(parts)), "/")
    taken = F.aggregate(segments, F.array().cast("array<string>"), walk)
    folder = F.element_at(segments, -1).isin(".", "..") & (F.size(taken) > 0)
    path = F.concat(F.lit("/"), F.array_join(taken, "/"), F.when(folder, "/").otherwise(""))
    head, tail = (F.regexp_extract(url, "(?s)^(https?://[^/?#]*)(/[^?#]*)?(.*)$", i) for i in (1, 3))
    return F.when(parts.rlike(r"/\.\.?(/|$)"), F.concat(head, path, tail)).otherwise(url)


def _resolved(t: Column, base: Column) -> Column:
    origin = F.regexp_extract(base, "(?i)^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "(?i)^(https?://[^/]+(?:/.*)?/)[^/]*$", "$1")
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when((t == "") | t.isNull(), None)
        .when(t.startswith("//"), F.concat(F.lit("https:"), t))
        .when(t.rlike("(?i)^https?://"), t)
        .when(t.rlike("(?i)^[a-z][a-z0-9+.-]*:"), None)
        .when(origin == "", None)
        .when(t.startswith("/"), _plain_path(F.concat(origin, t)))
        .when(t.startswith("?"), F.concat(F.regexp_replace(base, "[?#].*$", ""), t))
        .when(t.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), t))
        .otherwise(_plain_path(F.concat(folder, t)))
    )


def decode_email(code: Column) -> Column:
    """An address whose bytes are hidden by XOR with the first; null if it is none."""
    digits = F.regexp_replace(strip(code), "^#", "")
    byte = lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    plain = lambda i: F.decode(F.unhex(F.lpad(F.hex(byte(i).bitwiseXOR(byte(F.lit(0))).cast("long")), 8, "0")), "UTF-32")
    address = F.array_join(F.transform(F.sequence(F.lit(1), (F.length(digits) / 2).cast("int") - 1), plain), "")
    return F.when(digits.rlike("^([0-9a-fA-F]{2}){2,}$"), F.when(F.contains(address, F.lit("@")), address))


def is_public_target(url: Column) -> Column:
    """Whether the URL's host isn't a name or address of a private network."""
    host = F.lower(F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^\[|\]$", ""))
    mapped = F.regexp_extract(host, r"^::ffff:(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})$", 1)
    v4 = F.when(host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), host).when(mapped != "", mapped)
    octet = lambda i: F.try_element_at(F.split(v4, r"\."), F.lit(i)).cast("int")
    a, b = octet(1), octet(2)
    whole = (a <= 255) & (b <= 255) & (octet(3) <= 255) & (octet(4) <= 255)
    private = a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127))
    named = (host == "localhost") | host.rlike(r"\.(localhost|local|internal)$")
    v6 = host.isin("::", "::1") | host.rlike("^f[cd][0-9a-f]{2}:") | host.rlike("^fe[89ab][0-9a-f]:")
    bad = named | F.coalesce(whole & private, F.lit(False)) | (host.contains(":") & v6)
    return F.coalesce(url.rlike("(?i)^https?://") & (host != "") & ~bad, F.lit(False))


def is_junk_image_url(url: Column) -> Column:
    w, h = (F.regexp_extract(url, fixed.IMAGE_BOX, i) for i in (1, 2))
    small = (w != "") & ((w.try_cast("int") <= 200) | ((h.try_cast("int") > 0) & (h.try_cast("int") <= 120)))
    return url.rlike(fixed.JUNK_IMAGE_URL) | F.coalesce(small, F.lit(False))


def image_identity(url: Column) -> Column:
    """The same for one picture at two sizes or behind a resizing service."""
    u = F.lower(strip(url))
    nested = F.regexp_extract(u, "(?s)^.+(https?://.*?)$", 1)
    u = F.when(nested != "", nested).otherwise(u)
    return F.regexp_replace(F.substring_index(u, "?", 1), "[/#]+$", "")


def looks_like_feed(body: Column, content_type: Column) -> Column:
    head, kind = F.left(body, F.lit(900)), F.lower(content_type)
    xml = kind.contains("xml") | head.rlike(r"(?i)^\s*<\?xml") | head.rlike(r"(?i)<(rss|feed|rdf:RDF)\b")
    return F.when(head.rlike(r"^\s*\{"), kind.contains("json")).otherwise(xml)


def video_of(url: Column) -> Column:
    """(``provider``, ``video_id``) of an allowed embed address, else null."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    path = F.try_parse_url(url, F.lit("PATH"))
    short = F.regexp_extract(path, "^/([A-Za-z0-9_-]{6,})(?:/|$)", 1)
    vimeo = F.regexp_extract(path, r"^/video/(\d+)", 1)
    embed = F.regexp_extract(path, "^/(?:embed|v|shorts)/([A-Za-z0-9_-]{6,})", 1)
    found = F.when(host == "youtu.be", F.struct(F.lit("youtube").alias("provider"), short.alias("video_id")))
    found = found.when(host == "player.vimeo.com", F.struct(F.lit("vimeo").alias("provider"), vimeo.alias("video_id")))
    found = found.when(host.isin("youtube.com", "youtube-nocookie.com"), F.struct(F.lit("youtube").alias("provider"), embed.alias("video_id")))
    return F.when(found["video_id"] != "", found)
