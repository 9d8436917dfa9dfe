"""Markup to typed blocks, by one pass of a tokeniser over each document.

These are the library's vectorized helpers (Arrow in, Arrow out); everything else
is built-in expressions.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType
from pyspark.sql.pandas.types import to_arrow_type

from .. import fixed, schemas

_WS = re.compile(fixed.WS + "+")
_ENTITY = re.compile(r"&(#[xX]?[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")
_SKIPPED = {"script", "style", "head", "noscript", "iframe", "svg", "canvas", "form", "button", "select", "textarea", "video", "audio"}
_BREAKS = {"p", "div", "section", "article", "main", "tr", "li", "dd", "dt", "td", "th", "hr"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_FRAMES = {"blockquote", "ul", "ol", "pre", "figure", *_HEADINGS}
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def decode(text: str) -> str:
    """Known named references and numeric ones, in one pass; others stay."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name[0] != "#":
            return fixed.ENTITIES.get(name, fixed.ENTITIES.get(name.lower(), m[0]))
        try:
            code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
        except ValueError:
            return m[0]
        return chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else m[0]

    return _ENTITY.sub(one, text)


def squeeze(text: str) -> str:
    # white space of str.split is that of fixed.WS but for the byte order mark
    return " ".join(text.replace("\ufeff", " ").split())


def _spaced(text: str) -> str:
    """Runs of white space as one space, those at the ends too."""
    inner = squeeze(text)
    if not inner:
        return " " if text else ""
    return (" " if _WS.match(text) else "") + inner + (" " if _WS.match(text[-1]) else "")


def scrub(text: str) -> str:
    """``text`` without its trailers, squeezed; a pattern is tried only where the letters that it needs are found."""
    low = text.lower()
    if "appeared" in low:
        text = re.sub(fixed.POST_TRAILER, " ", text)
    if "read" in low or "comment" in low:
        text = re.sub(fixed.MORE_TRAILER, " ", text)
    if "[…]" in text:
        text = re.sub(fixed.ELLIPSIS_TRAILER, " ", text)
    return squeeze(text)


def resolve(raw: str | None, base: str | None) -> str | None:
    """An absolute http(s) URL, or null."""
    value = (raw or "").strip()
    if not value:
        return None
    if value.startswith("//"):
        return "https:" + value
    if re.match("(?i)https?://", value):
        return value
    if not base:
        return None
    try:
        found = urljoin(base, value)
        return found if urlsplit(found).scheme in ("http", "https") and urlsplit(found).netloc else None
    except ValueError:
        return None


def fnv(text: str) -> int:
    if not text:
        return 2166136261
    h = 2166136261
    data = text.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(data), 2):
        h = ((h ^ int.from_bytes(data[i : i + 2], "little")) * 16777619) & 0xFFFFFFFF
    return 2**32 - h if h >= 2**31 else h


def junk_url(url: str) -> bool:
    if re.search(fixed.JUNK_IMAGE_URL, url):
        return True
    box = re.search(fixed.IMAGE_BOX, url)
    return bool(box) and (int(box[1]) <= 200 or 0 < int(box[2]) <= 120)


def _candidates(srcset: str) -> list[tuple[str, float | None]]:
    out = []
    for entry in srcset.split(","):
        url, *marks = entry.split() or [""]
        width = None
        for mark in marks:
            if re.fullmatch(r"\d+w", mark):
                width = float(mark[:-1])
            elif re.fullmatch(r"\d*\.?\d+x", mark):
                width = float(mark[:-1]) * 1000
        if url:
            out.append((url, width))
    return out


def image_of(attrs: dict[str, str], base: str | None) -> str | None:
    """The URL that best shows an image, null for furniture."""
    for side in ("width", "height"):
        size = attrs.get(side, "")
        if size.isdigit() and 0 < int(size) <= 64:
            return None
    alt = attrs.get("alt", "")
    if re.search(fixed.JUNK_IMAGE_TAG, " ".join(filter(None, (attrs.get("class"), attrs.get("id"), alt)))) or re.search(fixed.SHARE_ALT, alt):
        return None
    found = [c for name in ("data-srcset", "srcset") for c in _candidates(attrs.get(name, ""))]
    found += [(attrs[name], None) for name in ("data-src", "data-original", "data-lazy-src", "data-actualsrc", "src") if attrs.get(name)]
    usable = [(u, w) for u, w in ((resolve(u, base), w) for u, w in found) if u and not junk_url(u)]
    sized = [x for x in usable if x[1] is not None]
    if not sized:
        return usable[0][0] if usable else None
    wide = [x for x in sized if x[1] >= fixed.IMAGE_WIDTH]
    return (min(wide, key=lambda x: x[1]) if wide else max(sized, key=lambda x: x[1]))[0]


def email_of(code: str | None) -> str | None:
    """An address whose bytes are hidden by XOR with the first."""
    code = (code or "").strip().removeprefix("#")
    if len(code) < 4 or len(code) % 2 or not re.fullmatch("[0-9a-fA-F]+", code):
        return None
    key, *rest = bytes.fromhex(code)
    address = "".join(chr(b ^ key) for b in rest)
    return address if "@" in address else None


class _Link(str):
    """Text of a link."""

    href: str | None = None


def _link(text: str, href: str | None) -> _Link:
    out = _Link(text)
    out.href = href
    return out


class _Frame:
    """What an open element gathers: text, links and finished blocks, in order."""

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs = tag, attrs or {}
        self.flow: list = []
        self.cite: list[str] | None = None

    def text(self) -> str:
        return squeeze(_CONTROL.sub("", "".join(x if isinstance(x, str) else " " for x in self.flow)))


def runs_of(flow: list) -> tuple[str, list[dict] | None]:
    """Collapsed text of a flow and, where it has links, its runs."""
    merged: list = []
    for x in flow:
        if isinstance(x, _Link) or not merged or isinstance(merged[-1], _Link):
            merged.append(x)
        else:
            merged[-1] += x
    parts = [x if isinstance(x, _Link) else _spaced(_CONTROL.sub("", x)) for x in merged]
    if parts and not isinstance(parts[0], _Link):
        parts[0] = parts[0].lstrip(" ")
    if parts and not isinstance(parts[-1], _Link):
        parts[-1] = parts[-1].rstrip(" ")
    parts = [p for p in parts if p]
    linked = any(isinstance(p, _Link) and p.href for p in parts)
    return "".join(parts), [{"text": str(p), "href": getattr(p, "href", None)} for p in parts] if linked else None


class _Reader(HTMLParser):
    def __init__(self, base: str | None):
        super().__init__(convert_charrefs=False)
        self.base = base
        self.frames = [_Frame("")]
        self.skipping: list[str] = []
        self.anchor: tuple[dict[str, str], int] | None = None
        self.picture: list[str] | None = None

    def error(self, message: str) -> None: ...

    @property
    def top(self) -> _Frame:
        return self.frames[-1]

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.top.flow.append(data)
            if self.top.cite is not None:
                self.top.cite.append(data)

    def handle_entityref(self, name: str) -> None:
        self.handle_data(decode(f"&{name};"))

    def handle_charref(self, name: str) -> None:
        self.handle_data(decode(f"&#{name};"))

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag not in _SKIPPED:
            self.handle_starttag(tag, attrs)

    def handle_starttag(self, tag: str, pairs) -> None:
        if self.skipping:
            if tag == self.skipping[-1]:
                self.skipping.append(tag)
            return
        attrs = {k: (v or "").strip() for k, v in reversed(pairs)}
        if tag in _SKIPPED:
            self.skipping.append(tag)
        elif tag == "a":
            self.anchor = (attrs, len(self.top.flow))
        elif tag == "picture":
            self.picture = []
        elif tag == "source" and self.picture is not None:
            self.picture.append(attrs.get("srcset", ""))
        elif tag == "img":
            self._image(attrs)
        elif tag == "br":
            self.top.flow.append("\n")
        elif tag == "cite":
            self.top.cite = []
        elif tag in _FRAMES:
            self.frames.append(_Frame(tag, attrs))
        elif tag == "li" and self.top.tag in ("ul", "ol"):
            self.frames.append(_Frame("li"))
        elif tag in _BREAKS:
            self.top.flow.append("\n\n" if self.top.tag == "" else " ")
        else:
            self._inline()

    def _inline(self) -> None:
        # inside a frame a tag separates words; in a paragraph it leaves no trace
        if self.top.tag not in ("", "pre"):
            self.top.flow.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if self.skipping:
            if tag == self.skipping[-1]:
                self.skipping.pop()
        elif tag == "a":
            self._end_anchor()
        elif tag == "picture":
            self.picture = None
        elif tag == "cite":
            if self.top.cite is not None and self.top.tag == "blockquote":
                self.top.attrs["cite-text"] = squeeze("".join(self.top.cite))[:120]
            self.top.cite = None
        elif tag in _FRAMES or tag == "li":
            if any(f.tag == tag for f in self.frames):
                while self.top.tag != tag:
                    self._spill()
                self._close(self.frames.pop())
            elif tag in _BREAKS:
                self.top.flow.append("\n\n")
        elif tag in _BREAKS:
            self.top.flow.append("\n\n" if self.top.tag == "" else " ")
        else:
            self._inline()

    def _image(self, attrs: dict[str, str]) -> None:
        if self.picture:
            attrs = attrs | {"srcset": ", ".join(filter(None, self.picture))}
        if self.anchor:
            self.anchor = None  # a link around an image is left to the image
        src = image_of(attrs, self.base)
        if self.top.tag == "figure":
            self.top.attrs.setdefault("img-src", src or "")
            self.top.attrs.setdefault("img-alt", attrs.get("alt", ""))
        elif src:
            self.top.flow.append({"kind": "figure", "src": src, "caption": decode(attrs.get("alt", "")), "seed": fnv(src)})

    def _end_anchor(self) -> None:
        if not self.anchor:
            return
        attrs, start = self.anchor
        self.anchor = None
        flow = self.top.flow
        if start > len(flow) or any(isinstance(x, dict) for x in flow[start:]):
            return
        label = squeeze("".join(flow[start:]))
        href = attrs.get("href", "")
        coded = re.search("(?i)/cdn-cgi/l/email-protection#([0-9a-f]+)", href)
        address = email_of(attrs.get("data-cfemail")) or email_of(coded[1] if coded else None)
        if address:
            label, target = (address if attrs.get("data-cfemail") else label or address), f"mailto:{address}"
        else:
            target = href if href.lower().startswith("mailto:") else resolve(href, self.base)
        flow[start:] = [_link(label, target)] if label else []

    def _spill(self) -> None:
        """An element that was never closed leaves its contents to the one around it."""
        frame = self.frames.pop()
        self.top.flow += frame.flow

    def _close(self, f: _Frame) -> None:
        blocks = [x for x in f.flow if isinstance(x, dict)]
        words = [x for x in f.flow if not isinstance(x, dict)]
        out = self.top.flow
        if f.tag == "li":
            text, inline = runs_of(words)
            clean = scrub(text)
            f.attrs = {"text": clean}
            self.top.attrs.setdefault("items", []).append((clean, inline if clean == text else None))  # type: ignore[union-attr]
            out += blocks
            return
        if f.tag == "figure":
            src = f.attrs.get("img-src")
            if src:
                caption = f.text() or decode(f.attrs.get("img-alt", ""))
                out.append({"kind": "figure", "src": src, "caption": caption, "seed": fnv(src)})
            else:
                out += f.flow
            return
        if f.tag == "pre":
            body = "".join(words).strip("\n")
            if body.strip():
                out.append({"kind": "code", "text": body[:1400]})
        elif f.tag in ("ul", "ol"):
            items = [(t, i) for t, i in f.attrs.get("items", []) if 2 <= len(t) < 400][:12]  # type: ignore[union-attr]
            if len(items) >= 2:
                rich = [i or [] for _, i in items]
                out.append({"kind": "list", "items": [t for t, _ in items], "inline_items": rich if any(rich) else None})
        else:
            text, inline = runs_of(words)
            clean = scrub(text)
            if f.tag == "blockquote":
                if len(text) >= 12:
                    quote = clean[:700]
                    out.append({"kind": "quote", "text": quote, "cite": f.attrs.get("cite-text"), "inline": inline if quote == text else None})
            elif 2 <= len(clean) <= 180:
                out.append({"kind": "h2", "text": clean, "inline": inline if clean == text else None})
        out += blocks

    def finish(self) -> list:
        self.close()
        while len(self.frames) > 1:
            self._spill()
        return self.frames[0].flow


def _chunks(flow: list):
    """Blocks and paragraphs (lists of text and links), with the end of each chunk as None."""
    part: list = []
    for x in flow:
        if isinstance(x, dict):
            if part:
                yield part
            part = []
            yield x
        elif isinstance(x, _Link):
            part.append(x)
        else:
            first, *rest = re.split(r"\n[ \t]*\n[\n \t]*|\n{2,}", x)
            part.append(first)
            for piece in rest:
                yield part
                yield None
                part = [piece]
    yield part
    yield None


def blocks_of(html: str | None, base: str | None, budget: tuple[int, int] = fixed.FEED_BUDGET) -> tuple[list[dict], bool]:
    """The blocks of a document's markup and whether the budget cut them off."""
    if not html:
        return [], False
    reader = _Reader(base)
    reader.feed(html)
    out: list[dict] = []
    spent, cut = 0, False
    full = lambda: len(out) >= budget[0] or spent >= budget[1]
    # empty pieces between breaks belong to no chunk
    said = False
    for piece in _chunks(_joined(reader.finish())):
        if piece is None:
            if said and full():
                cut = True
                break
            said = False
        elif isinstance(piece, dict):
            out.append(piece)
            spent += 120
            said = True
        else:
            text, inline = runs_of(piece)
            body = scrub(text)
            said = said or bool(text)
            if len(body) < 2:
                continue
            if len(body) > 2400:
                out += [{"kind": "p", "text": t} for t in _regroup(body)]
            else:
                out.append({"kind": "p", "text": body, "inline": inline if body == text else None})
            spent += len(body)
            if full():
                cut = True
                break
    return _without_repeats(out), cut


def _joined(flow: list) -> list:
    """Neighbouring texts as one, so that breaks made of several line ends are seen."""
    out: list = []
    for x in flow:
        if out and type(x) is str and type(out[-1]) is str:
            out[-1] += x
        else:
            out.append(x)
    return out


_SENTENCE = re.compile(r"[^.!?]+[.!?]+[\"'”’)]?\s*")
_AFTER_STOP = re.compile(r"[\"'”’)]?\s*")


def _sentences(text: str) -> list[str]:
    """All matches of ``_SENTENCE``.  What follows the last stop holds none and isn't searched, as each of its characters would be looked at once for each before it."""
    stop = max(text.rfind(mark) for mark in ".!?")
    return _SENTENCE.findall(text, 0, _AFTER_STOP.match(text, stop + 1).end()) if stop >= 0 else []


def _regroup(text: str, most: int = 900) -> list[str]:
    """A very long paragraph as several of whole sentences."""
    out, held = [], ""
    for sentence in _sentences(text) or [text]:
        if held and len(held) + len(sentence) > most:
            out.append(held.strip())
            held = ""
        held += sentence
    return [*out, held.strip()] if held.strip() else out


def _without_repeats(blocks: list[dict]) -> list[dict]:
    seen: set[str] = set()
    out = []
    for i, b in enumerate(blocks):
        if b["kind"] == "figure":
            if b["src"] in seen:
                continue
            seen.add(b["src"])
        if b["kind"] == "p" and i and blocks[i - 1]["kind"] == "p" and blocks[i - 1]["text"] == b["text"]:
            continue
        out.append(b)
    return out


#: Rows of a batch that are Python objects at a time; those of a whole batch would be many times its bytes.
_ROWS = 64


def _helper(one, ddl: str, *columns: Column) -> Column:
    """An Arrow function of rows; made when it is used, as its type needs a session."""
    kind = to_arrow_type(DataType.fromDDL(ddl))

    def run(*arrays: pa.Array) -> pa.Array:
        some = lambda i: zip(*(a.slice(i, _ROWS).to_pylist() for a in arrays))
        parts = [pa.array([one(*row) for row in some(i)], kind) for i in range(0, len(arrays[0]), _ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    # Spark tells scalar Arrow functions by their hints
    if len(columns) == 1:

        def call(a: pa.Array) -> pa.Array:
            return run(a)
    else:

        def call(a: pa.Array, b: pa.Array) -> pa.Array:
            return run(a, b)

    return F.arrow_udf(call, ddl)(*columns)


def html_blocks(html: Column, base: Column, budget: tuple[int, int] = fixed.FEED_BUDGET) -> Column:
    """(``blocks``, ``truncated``) of markup."""
    return _helper(lambda h, b: dict(zip(("blocks", "truncated"), blocks_of(h, b, budget))), f"STRUCT<blocks: {schemas.BODY}, truncated: BOOLEAN>", html, base)


class _Region(HTMLParser):
    """Start and end of the part of a page that holds the article."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=False)
        self.html = html
        self.lines = [0]
        for m in re.finditer("\n", html):
            self.lines.append(m.end())
        self.open: list[tuple[str, int, str]] = []
        self.found: dict[str, str] = {}
        self.drop: list[tuple[int, int]] = []

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag: str, pairs) -> None:
        attrs = dict(pairs)
        role = "main" if tag == "main" or (attrs.get("role") or "").lower() == "main" else tag
        if role in ("article", "main", "body") or tag in ("nav", "header", "footer", "aside", "form"):
            self.open.append((tag, self._at(), role))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                _, start, role = self.open.pop(i)
                end = self._at()
                inner = self.html[start:end]
                if role in ("nav", "header", "footer", "aside", "form"):
                    self.drop.append((start, self.html.find(">", end) + 1 or end))
                elif role == "body":
                    for a, b in sorted(self.drop, reverse=True):
                        if start <= a and b <= end:
                            inner = inner[: a - start] + inner[b - start :]
                    self.found.setdefault("body", inner)
                else:
                    self.found.setdefault(role, inner)
                return


def region_of(html: str) -> str:
    """Markup of the first article, else of the main part, else of the body without its furniture."""
    r = _Region(html)
    r.feed(html)
    return next((r.found[k] for k in ("article", "main", "body") if r.found.get(k)), "")


def meta_of(html: str, name: str) -> str | None:
    tag = re.search(rf"(?i)<meta\b[^>]*(?:property|name)=[\"']{re.escape(name)}[\"'][^>]*>", html)
    content = re.search(r"(?i)\bcontent=[\"']([^\"']*)[\"']", tag[0]) if tag else None
    return decode(content[1]) or None if content else None


def video_from(url: str) -> tuple[str, str] | None:
    try:
        parts = urlsplit(url)
    except ValueError:
        return None
    host = re.sub(r"^www\.", "", (parts.hostname or "").lower())
    rules = {
        "youtu.be": ("youtube", "/([A-Za-z0-9_-]{6,})(?:/|$)"),
        "player.vimeo.com": ("vimeo", r"/video/(\d+)"),
        "youtube.com": ("youtube", "/(?:embed|v|shorts)/([A-Za-z0-9_-]{6,})"),
        "youtube-nocookie.com": ("youtube", "/(?:embed|v|shorts)/([A-Za-z0-9_-]{6,})"),
    }
    if host not in rules:
        return None
    m = re.match(rules[host][1], parts.path)
    return (rules[host][0], m[1]) if m else None


def _ld_json(html: str) -> list[str]:
    return re.findall(r"(?is)<script\b[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", html)


def _declared_video(node) -> dict | None:
    """The first video object in a tree of JSON with an address we know."""
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            kind = x.get("@type")
            if kind == "VideoObject" or isinstance(kind, list) and "VideoObject" in kind:
                for key in ("embedUrl", "contentUrl"):
                    found = video_from(x[key]) if isinstance(x.get(key), str) else None
                    if found:
                        return {"provider": found[0], "video_id": found[1], "title": x["name"] if isinstance(x.get("name"), str) else None}
            todo += reversed(list(x.values()))
        elif isinstance(x, list):
            todo += reversed(x)
    return None


def video_of_page(html: str) -> dict | None:
    for text in _ld_json(html):
        try:
            found = _declared_video(json.loads(text))
        except (ValueError, RecursionError):
            continue
        if found:
            return found
    addresses = [meta_of(html, p) for p in ("og:video:secure_url", "og:video:url", "og:video", "twitter:player")]
    addresses += re.findall(r"(?i)<iframe\b[^>]*\bsrc=[\"']([^\"']+)[\"']", html)
    for address in filter(None, addresses):
        found = video_from(address)
        if found:
            return {"provider": found[0], "video_id": found[1], "title": None}
    return None


def declares_video(html: str) -> bool:
    kind = (meta_of(html, "og:type") or "").strip().lower()
    if kind.startswith("video") or kind == "article":
        return kind != "article"
    return any('"VideoObject"' in text for text in _ld_json(html))


PAGE_DDL = (
    f"STRUCT<title: STRING, author: STRING, site: STRING, published: STRING, image: STRING, blocks: {schemas.BODY}, truncated: BOOLEAN, "
    "text: STRING, video: STRUCT<provider: STRING, video_id: STRING, title: STRING>, video_page: BOOLEAN>"
)


def page_of(html: str | None, url: str | None) -> dict:
    html = html or ""
    region = region_of(html)
    blocks, cut = blocks_of(region, url, fixed.ARTICLE_BUDGET)
    heading = re.search(r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", region) or re.search(r"(?is)<title\b[^>]*>(.*?)</title\s*>", html)
    title = meta_of(html, "og:title") or (squeeze(decode(re.sub("<[^>]*>", " ", heading[1]))) if heading else None)
    image = resolve(meta_of(html, "og:image"), url)
    video = video_of_page(html)
    plain = re.sub(r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "", region)
    return {
        "title": title or None,
        "author": meta_of(html, "author"),
        "site": meta_of(html, "og:site_name"),
        "published": meta_of(html, "article:published_time"),
        "image": image if image and not junk_url(image) else None,
        "blocks": blocks,
        "truncated": cut,
        "text": squeeze(decode(re.sub("<[^>]*>", "", plain))),
        "video": video,
        "video_page": video is None and declares_video(html),
    }


def read_page(html: Column, url: Column) -> Column:
    """What a page's markup holds; ``operators.pages`` decides on it."""
    return _helper(page_of, PAGE_DDL, html, url)
