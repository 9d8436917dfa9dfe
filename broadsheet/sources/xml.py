"""Makes feeds that are not strict XML readable for ``from_xml``, by Column functions alone.

Published feeds name references that XML doesn't define, leave ampersands and less-than
signs bare, leave ``br`` and ``img`` open and put markup into titles.  Everything here works
outside CDATA sections; what stands in them is text already.  Strict documents are passed on
as they are, for one look at each.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as tx

_OPEN, _CLOSE = "<![CDATA[", "]]>"
#: What a strict document has none of: undefined references, bare signs, characters that XML forbids, open tags, markup in texts.
_REFERENCE = r"&(?!(?:amp|lt|gt|quot|apos|#0*(?:9|1[03]|3[2-9]|[4-9][0-9]|[1-9][0-9]{2,6})|#x0*(?:9|[aAdD]|[2-9a-fA-F][0-9a-fA-F]|[1-9a-fA-F][0-9a-fA-F]{2,5}));)"
_SIGN = r"<(?![A-Za-z_/!?])"
_FORBIDDEN = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]"
_VOID = r"(?i)<(br|hr|img|input|wbr)\b([^<>]*?)\s*/?>(?:</\1\s*>)?"
_DOCTYPE = r"(?s)<!DOCTYPE[^>\[]*(?:\[.*?\]\s*)?>"
_TEXT_STARTS = f"(?=<(?:{'|'.join(fixed.FEED_TEXTS)})[\\s>])"


def _outside(body: Column, f) -> Column:
    """``body`` with ``f`` applied to what isn't CDATA."""

    def piece(part: Column, i: Column) -> Column:
        inside = F.substring_index(part, _CLOSE, 1)
        rest = F.substring(part, F.length(inside) + 1, F.length(part))
        return F.when(i == 0, f(part)).otherwise(F.concat(F.lit(_OPEN), inside, F.left(rest, F.lit(len(_CLOSE))), f(F.substring(rest, F.lit(len(_CLOSE) + 1), F.length(part)))))

    return F.array_join(F.transform(F.split(body, r"<!\[CDATA\["), piece), "")


def _named(c: Column) -> Column:
    """References of HTML that feeds use as if XML defined them, as their characters."""
    names = "|".join(fixed.XML_REFERENCES)
    table = F.create_map(*[F.lit(x) for pair in fixed.XML_REFERENCES.items() for x in pair])
    name = lambda part: F.substring_index(part, ";", 1)
    parts = F.split(c, f"&(?=(?:{names});)")
    known = lambda part: F.concat(F.try_element_at(table, name(part)), F.substring(part, F.length(name(part)) + 2, F.length(part)))
    return F.array_join(F.transform(parts, lambda part, i: F.when(i == 0, part).otherwise(known(part))), "")


def _strict(c: Column) -> Column:
    """Markup between CDATA sections with references, signs and void tags as XML wants them."""
    c = F.regexp_replace(c, _REFERENCE, "&amp;")
    c = F.regexp_replace(c, _SIGN, "&lt;")
    return F.regexp_replace(c, _VOID, "<$1$2/>")


def _whole_texts(body: Column) -> Column:
    """Text elements with markup inside as CDATA, so that the text around tags stays together and tags are read as HTML."""

    def one(part: Column) -> Column:
        name = F.regexp_extract(part, r"^<([\w:]+)", 1)
        opened = F.regexp_extract(part, r"^<[\w:]+(?:\s[^<>]*)?>", 0)
        rest = F.substring(part, F.length(opened) + 1, F.length(part))
        end = F.position(F.concat(F.lit("</"), name), rest)
        inner = F.left(rest, end - 1)
        mixed = (opened != "") & ~opened.endswith("/>") & (end > 1) & inner.rlike("<[A-Za-z]") & ~inner.contains(_OPEN)
        return F.when(mixed, F.concat(opened, F.lit(_OPEN), F.replace(F.regexp_replace(inner, _SIGN, "&lt;"), F.lit("&amp;"), F.lit("&")), F.lit(_CLOSE), F.substring(rest, end, F.length(rest)))).otherwise(part)

    return F.array_join(F.transform(F.split(body, _TEXT_STARTS), lambda part: tx.let(part, one)), "")


def readable(body: Column) -> Column:
    """A feed document as strict XML, as far as it can be made so."""
    mixed = body.rlike(rf"<(?:{'|'.join(fixed.FEED_TEXTS)})(?:\s[^<>]*)?>[^<]*(?:{_SIGN}[^<]*)*<[A-Za-z]")
    loose = body.rlike(_REFERENCE) | body.rlike(_SIGN) | body.rlike(_FORBIDDEN) | body.rlike(r"(?i)<(br|hr|img|input|wbr)\b") | body.contains("<!DOCTYPE")
    named = _outside(F.regexp_replace(F.regexp_replace(body, _FORBIDDEN, ""), _DOCTYPE, ""), _named)
    whole = tx.let(named, lambda c: F.when(mixed, _whole_texts(c)).otherwise(c))
    return F.when(loose | mixed, _outside(whole, _strict)).otherwise(body)
