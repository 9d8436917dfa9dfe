"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A text is scored as the bytes of its words (A-Z lower-cased) with one space
between them and an end byte after the last.  Each byte is eight binary
decisions, from the top bit down; each decision has a tree of contexts, the
preceding 0 to ``DEPTH`` bytes of the text.  A node's counts give a
Krichevsky-Trofimov estimate; a node mixes its own estimate and that of the
deeper nodes, half and half, for the whole training text:

    log Pw(s) = log(1/2) + log(Pe(s) + prod Pw(children))

so a new decision's probability is the nested mixture of the estimates at all
depths, each node trusted by its share ``Pe / (Pe + prod Pw(children))``.  The sum
over the bytes of a text is its code length.

Counts are those of (``DEPTH`` + 1)-byte strings over all training texts.  They
and their models lie in buckets and are never broadcast: documents are dealt to
chunks, and each chunk gets the values of the strings that it has.  A bucket holds
the strings of some contexts of three bytes; one of two bytes is spread over
``SPREAD`` buckets, so that a very common one isn't one task's.  The nodes of
depth 2 are therefore summed over buckets and sent back to those that need them;
depths 0 and 1, at most 257 x 255 nodes, are the only part that goes to every task.

Beside it stands a unigram model of whole words (the base), gathered likewise.

Code lengths of bytes are exchanged with 16 significant bits, so a text's score has a
relative error of at most 2 ** -17.

Defined results: a null text counts as empty, which is the end alone.  A null id
is in the training part.  Repeated rows count, and are scored, each.  With no
training texts all counts are 0.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, stored
from .hashing import mix64, slices

DEPTH = 6
FOLDS, HELD_OUT = 5, 1
#: Bytes of text in a chunk, about.
CHUNK_BYTES = 16 << 20
#: Bytes of text for each bucket of strings, about; there are some 2 ** 20 places to deal to buckets.
BUCKET_BYTES = 32 << 20
MOST_BUCKETS = 1 << 16
SPREAD = 16
#: Contexts of more bytes than this lie whole in one bucket.
SPLIT = 3
#: Bytes of text whose strings are in memory at once, and documents, whose numbers take 8 bits.
PIECE_BYTES, PIECE_DOCS = 1 << 20, 256
#: Stands for the end of a text among the words; no word holds white space.
END_WORD = " "
END_BYTE = 0x0A
_HALF = math.log(0.5)


def normal_bytes(text: str | None) -> tuple[list[bytes], bytes]:
    """Words of a text, and the bytes that are scored."""
    words = (text or "").encode().lower().split()
    return words, b" ".join(words) + b"\n"


def byte_strings(data: list[bytes], depth: int = DEPTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For the bytes of some texts, ``PIECE_BYTES`` at a time: the number made of a byte and the
    ``depth`` bytes before it, and which text it is of.

    What lies before a text counts as end bytes.
    """
    size = np.array([len(x) for x in data], np.int64)
    gap = bytes([END_BYTE]) * depth
    joined = bytes([END_BYTE]) * 8 + gap.join(data)
    begin = 8 + np.cumsum(size + depth) - size - depth
    for a in range(8, len(joined), PIECE_BYTES):
        b = min(a + PIECE_BYTES, len(joined))
        # the 8 bytes that end at each place, the oldest first
        window = np.ndarray((b - a,), ">u8", joined, a - 7, (1,)).astype(np.int64) & ((1 << (8 * (depth + 1))) - 1)
        first, last = int(np.searchsorted(begin, a, "right")) - 1, int(np.searchsorted(begin, b))
        starts, ends = np.maximum(begin[first:last], a) - a, np.minimum(begin[first:last] + size[first:last], b) - a
        some = ends > starts
        turn = np.zeros(b - a + 1, np.int8)
        turn[starts[some]] += 1
        turn[ends[some]] -= 1
        yield window[np.cumsum(turn[:-1], dtype=np.int8).astype(bool)], np.repeat(np.arange(first, last), np.maximum(ends - starts, 0))


def strings_of(data: list[bytes], depth: int = DEPTH) -> np.ndarray:
    """All of ``byte_strings``."""
    return np.concatenate([x for x, _ in byte_strings(data, depth)])


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 0.5, by Stirling's series at x + 8."""
    low = np.zeros_like(x)
    for i in range(8):
        low += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


class Level:
    """The nodes of one depth: ``key`` is (context << 8) | bits so far, with a leading 1."""

    def __init__(self, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, children: np.ndarray | None):
        self.key, self.n0, self.n1 = key, n0, n1
        own = log_kt(n0, n1)
        if children is None:
            self.trust, self.log_pw = np.ones(len(key)), own
        else:
            both = np.logaddexp(own, children)
            self.trust, self.log_pw = np.exp(own - both), _HALF + both
        self.one = (n1 + 0.5) / (n0 + n1 + 1.0)


def deepest_nodes(strings: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys and counts of the deepest nodes, and for each string its node at each of the 8 bits."""
    byte = strings & 255
    bit_keys = np.stack([(strings & ~np.int64(255)) | (1 << j) | (byte >> (8 - j)) for j in range(8)], axis=1)
    bits = np.stack([(byte >> (7 - j)) & 1 for j in range(8)], axis=1)
    key, at = np.unique(bit_keys.ravel(), return_inverse=True)
    weight = np.repeat(counts.astype(float), 8)
    n1 = np.bincount(at, weight * bits.ravel(), minlength=len(key))
    n0 = np.bincount(at, weight, minlength=len(key)) - n1
    return key, n0, n1, at.reshape(-1, 8)


def parents(level: Level, depth: int) -> tuple[Level, np.ndarray]:
    """The level one shallower (of ``depth``), and for each node its parent there."""
    key, at = np.unique(level.key & ((np.int64(1) << (8 * (depth + 1))) - 1), return_inverse=True)
    total = lambda x: np.bincount(at, x, minlength=len(key))
    return Level(key, total(level.n0), total(level.n1), total(level.log_pw)), at


def tree_levels(strings: np.ndarray, counts: np.ndarray, depth: int, lowest: int) -> tuple[list[Level], list[np.ndarray], np.ndarray]:
    """Levels from ``depth`` up to ``lowest``, links from each to the next, and the strings' nodes."""
    key, n0, n1, at = deepest_nodes(strings, counts)
    levels, links = [Level(key, n0, n1, None)], []
    for d in range(depth - 1, lowest - 1, -1):
        level, link = parents(levels[-1], d)
        levels.append(level)
        links.append(link)
    return levels, links, at


def log2_of_strings(strings: np.ndarray, counts: np.ndarray, depth: int, top: dict[int, np.ndarray], second: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
    """log2 probability of each string's last byte after the bytes before it.

    ``top`` has, for depths 0 and 1, arrays [context, bits so far, (trust, P(1))];
    ``second``, for trees deeper than 2, sorted keys, trusts and P(1) of depth 2.
    """
    lowest = min(SPLIT, depth)
    levels, links, at = tree_levels(strings, counts, depth, lowest)
    one = levels[0].one.copy()  # the mixture from the deepest level up, for each deepest node
    node = np.arange(len(one))
    for level, link in zip(levels[1:], links):
        node = link[node]
        one = level.trust[node] * level.one[node] + (1 - level.trust[node]) * one
    key = levels[0].key
    if depth >= SPLIT:
        keys, trusts, ones = second
        place = np.searchsorted(keys, key & 0xFFFFFF)
        one = trusts[place] * ones[place] + (1 - trusts[place]) * one
    for d in (1, 0):
        trust, p = np.moveaxis(top[d][(key >> 8) & (255 if d else 0), key & 255], -1, 0)
        one = trust * p + (1 - trust) * one
    bits = np.stack([((strings & 255) >> (7 - j)) & 1 for j in range(8)], axis=1)
    p = one[at]
    return np.log2(np.where(bits == 1, p, 1 - p)).sum(axis=1)


def _level(nodes: pa.Table | pa.RecordBatch) -> Level:
    """Nodes (``key``, ``n0``, ``n1``, sum ``children`` of log Pw) as a level."""
    key, n0, n1, children = (nodes.column(c).to_numpy() for c in ("key", "n0", "n1", "children"))
    return Level(key.astype(np.int64), n0.astype(float), n1.astype(float), children.astype(float))


def top_levels(nodes: pa.Table) -> dict[int, np.ndarray]:
    """Depths 0 and 1 from the summed nodes of depth 1."""
    level = _level(nodes)
    root, _ = parents(level, 0)
    out = {}
    for d, x in ((1, level), (0, root)):
        table = np.zeros((256 if d else 1, 256, 2))
        table[..., 0], table[..., 1] = 0.5, 0.5
        table[x.key >> 8, x.key & 255] = np.stack([x.trust, x.one], axis=1)
        out[d] = table
    return out


def _dealt(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, int]:
    """(``chunk``, ``doc_id``, ``held_out``, ``text``), and the numbers of chunks and buckets."""
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS))
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = max(1, math.ceil(size / CHUNK_BYTES))
    buckets = min(MOST_BUCKETS, max(1, math.ceil(size / BUCKET_BYTES)))
    chunk = F.pmod(F.xxhash64(F.col(id_col), text), F.lit(chunks)).cast("int")
    rows = docs.select(chunk.alias("chunk"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), text.alias("text"))
    return rows, chunks, buckets


def _pack(values: np.ndarray) -> bytes:
    """Numbers of a kind, compressed: bytes of equal weight stand together."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: pa.Scalar, kind: type = np.int64) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data.as_buffer()), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted numbers as differences."""
    return _pack(np.diff(keys, prepend=np.int64(0)))


def _unpack_sorted(data: pa.Scalar) -> np.ndarray:
    return np.cumsum(_unpack(data))


def _pack_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(words))


def _unpack_words(data: pa.Scalar) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data.as_buffer()).split(b"\n")


def _batch(schema: str, *rows: tuple) -> pa.RecordBatch:
    """Rows as a batch; ``schema`` as in DDL, of int, long, double and binary columns."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, t in enumerate(types)], names=list(names))


_NODES, _STRINGS, _WORDS, _TEXTS = 0, 1, 2, 3
_BLOCK = "bucket int, kind int, chunk int, keys binary, counts binary"


class _Gatherer:
    """Training counts of all strings and words that one chunk has."""

    def __init__(self, depth: int):
        self.depth = depth
        self.words: Counter = Counter()
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, held: bool, texts: list[str]) -> None:
        data: list[bytes] = []
        end = END_WORD.encode()
        for text in texts:
            tokens, raw = normal_bytes(text)
            data.append(raw)
            tokens.append(end)
            if held:
                for w in tokens:
                    self.words.setdefault(w, 0)
            else:
                self.words.update(tokens)
        for strings, _ in byte_strings(data, self.depth):
            strings.sort()
            first = _firsts(strings)
            n = np.zeros(len(first), np.int64) if held else np.diff(first, append=len(strings))
            self.parts.append((strings[first], n))
            self.waiting += len(first)
            if self.waiting > 2_000_000:
                self.merge()

    def merge(self) -> None:
        self.parts = [_sum_by_key(*(np.concatenate(x) for x in zip(*self.parts)))]
        self.waiting = 0

    def blocks(self, chunk: int, buckets: int) -> Iterator[pa.RecordBatch]:
        self.merge()
        key, n = self.parts.pop()
        bucket = _bucket_of(key, buckets)
        order = np.argsort(bucket, kind="stable")
        begins = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(begins)).tolist():
            at = order[begins[b] : begins[b + 1]]
            yield _batch(_BLOCK, (b, _STRINGS, chunk, _pack_sorted(key[at]), _pack(n[at])))
        dealt: dict[int, list[bytes]] = {}
        for w in self.words:
            dealt.setdefault(zlib.crc32(w) % buckets, []).append(w)
        for b, words in dealt.items():
            words.sort()
            yield _batch(_BLOCK, (b, _WORDS, chunk, _pack_words(words), _pack(np.array([self.words[w] for w in words], np.int64))))


def _deal(context: np.ndarray, third: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a context of two bytes with the byte before it."""
    place = context.astype(np.uint64) * np.uint64(SPREAD) + (mix64(third.astype(np.uint64) + np.uint64(1)) & np.uint64(SPREAD - 1))
    return (mix64(place + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)


def _bucket_of(strings: np.ndarray, buckets: int) -> np.ndarray:
    return _deal((strings >> 8) & 0xFFFF, (strings >> 24) & 0xFF, buckets)


def _sum_by_key(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = _firsts(key)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _gather(depth: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gatherers: dict[int, _Gatherer] = {}
        for whole in batches:
            for batch in slices(whole, "text", PIECE_BYTES):
                chunk_of = batch.column("chunk").to_numpy()
                held = batch.column("held_out").to_numpy(zero_copy_only=False)
                for chunk in np.unique(chunk_of).tolist():
                    for value in (False, True):
                        texts = batch.column("text").filter(pa.array((chunk_of == chunk) & (held == value))).to_pylist()
                        if texts:
                            gatherers.setdefault(chunk, _Gatherer(depth)).add(value, texts)
        while gatherers:
            chunk, gatherer = gatherers.popitem()
            yield from gatherer.blocks(chunk, buckets)

    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per bucket and kind: all its strings or words with the sums of their counts.

    Blocks are read one by one; what is held is the distinct ones of a bucket.
    """
    strings: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    words: dict[int, dict[bytes, int]] = {}
    for bucket, kind, keys, counts in _each(batches, "bucket", "kind", "keys", "counts"):
        b, n = bucket.as_py(), _unpack(counts)
        if kind.as_py() == _STRINGS:
            parts = strings.setdefault(b, [])
            parts.append((_unpack_sorted(keys), n))
            # merged when the new ones outweigh what was merged before
            if sum(len(p[0]) for p in parts[1:]) > max(1_000_000, len(parts[0][0])):
                parts[:] = [_sum_by_key(*(np.concatenate(x) for x in zip(*parts)))]
        else:
            total = words.setdefault(b, {})
            for w, c in zip(_unpack_words(keys), n.tolist()):
                total[w] = total.get(w, 0) + c
    for b, parts in strings.items():
        key, n = _sum_by_key(*(np.concatenate(x) for x in zip(*parts)))
        yield _batch(_BLOCK, (b, _STRINGS, -1, _pack_sorted(key), _pack(n)))
    for b, total in words.items():
        yield _batch(_BLOCK, (b, _WORDS, -1, _pack_words(list(total)), _pack(np.array(list(total.values()), np.int64))))


def _each(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c) for c in names))


def _by_context(strings: np.ndarray, depth: int, most: int = 1 << 16) -> Iterator[np.ndarray]:
    """Places of the strings, some contexts of ``SPLIT`` bytes at a time: their trees are apart from that depth down."""
    context = (strings >> 8) & ((1 << (8 * min(SPLIT, depth))) - 1)
    order = np.argsort(context, kind="stable")
    first = _firsts(context[order])
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(first, first[i] + most)))
        yield order[first[i] : first[j] if j < len(first) else None]
        i = j


_NODE = "key long, n0 double, n1 double, children double"


def _above(level: Level, depth: int) -> pa.RecordBatch:
    """What a level's nodes give to their parents, of ``depth``."""
    key, at = np.unique(level.key & ((1 << (8 * (depth + 1))) - 1), return_inverse=True)
    return pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(np.bincount(at, v, minlength=len(key))) for v in (level.n0, level.n1, level.log_pw))], names=["key", "n0", "n1", "children"])


def _lowest_nodes(depth: int):
    lowest = min(SPLIT, depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _each(batches, "keys", "counts"):
            key, n = _unpack_sorted(keys), _unpack(counts)
            for at in _by_context(key, depth):
                levels, _, _ = tree_levels(key[at], n[at], depth, lowest)
                yield _above(levels[-1], lowest - 1)

    return run


def _first_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _above(_level(batch), 1)


def _second_nodes(buckets: int):
    """Models of depth 2 as blocks for the buckets that hold their contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _level(batch)
            # every third byte that leads to a bucket of its own
            thirds = [np.flatnonzero((mix64(np.arange(1, 257, dtype=np.uint64)) & np.uint64(SPREAD - 1)) == s)[:1] for s in range(SPREAD)]
            to = [_deal(x.key >> 8, np.full(len(x.key), t[0]), buckets) for t in thirds if len(t)]
            pairs = np.unique(np.stack([np.concatenate(to), np.tile(np.arange(len(x.key)), len(to))]), axis=1)
            first = _firsts(pairs[0])
            for i, j in zip(first.tolist(), [*first[1:].tolist(), pairs.shape[1]]):
                at = pairs[1, i:j]
                yield _batch(_BLOCK, (int(pairs[0, i]), _NODES, -1, _pack(x.key[at]), _pack(np.concatenate([x.trust[at], x.one[at]]))))

    return run


_ANSWER = "chunk int, kind int, keys binary, value binary"


def _answer(depth: int, top: dict[int, np.ndarray]):
    """For each block of a chunk the values of its strings (code lengths) or words (counts).

    Of a bucket the nodes of depth 2 come first; of a kind the sums, as chunk -1.
    """

    def model(key: np.ndarray, n: np.ndarray, nodes: list[tuple[np.ndarray, ...]]) -> np.ndarray:
        second = tuple(np.concatenate(x) for x in zip(*nodes)) if nodes else None
        if second:
            order = np.argsort(second[0])
            second = tuple(x[order] for x in second)
        bits = np.empty(len(n), np.float32)
        for at in _by_context(key, depth):
            bits[at] = log2_of_strings(key[at], n[at], depth, top, second)
        # rounded to 16 bits, as the rest would not compress: a relative error of 2 ** -17 at most
        return ((bits.view(np.uint32) + np.uint32(0x80)) & np.uint32(0xFFFFFF00)).view(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = keys = values = None
        nodes: list[tuple[np.ndarray, ...]] = []
        table: dict[bytes, int] = {}
        for b, kind, chunk, asked, n in _each(batches, "bucket", "kind", "chunk", "keys", "counts"):
            b, kind, chunk = b.as_py(), kind.as_py(), chunk.as_py()
            if b != bucket:
                bucket, nodes, keys, values, table = b, [], None, None, {}
            if kind == _NODES:
                nodes.append((_unpack(asked), *np.split(_unpack(n, np.float64), 2)))
            elif kind == _STRINGS:
                mine = _unpack_sorted(asked)
                if chunk < 0:
                    keys, values = mine, model(mine, _unpack(n), nodes)
                else:
                    yield _batch(_ANSWER, (chunk, kind, asked.as_py(), _pack(values[np.searchsorted(keys, mine)])))
            else:
                mine = _unpack_words(asked)
                if chunk < 0:
                    table = dict(zip(mine, _unpack(n).tolist()))
                else:
                    yield _batch(_ANSWER, (chunk, kind, asked.as_py(), _pack(np.array([table[w] for w in mine], np.int64))))

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """One row per document: the base's counts and score, ``score`` (log10) and ``bits_per_byte``."""
    if not 2 <= depth <= DEPTH:
        raise ValueError(f"depth must be 2 to {DEPTH}")
    rows, chunks, buckets = _dealt(docs, id_col, text_col)
    blocks = stored(rows.repartitionById(chunks, "chunk").mapInArrow(_gather(depth, buckets), _BLOCK))
    sums = stored(blocks.repartitionById(buckets, "bucket").mapInArrow(_sum_blocks, _BLOCK))

    total = [F.sum(c).alias(c) for c in ("n0", "n1", "children")]
    nodes = sums.where(F.col("kind") == _STRINGS).mapInArrow(_lowest_nodes(depth), _NODE).groupBy("key").agg(*total)
    model = sums.unionByName(blocks)
    if depth >= SPLIT:
        second = checkpoint(nodes)
        nodes = second.mapInArrow(_first_nodes, _NODE).groupBy("key").agg(*total)
        model = model.unionByName(second.mapInArrow(_second_nodes(buckets), _BLOCK))
    top = top_levels(nodes.toArrow())  # 256 x 255 rows at most
    train = sums.where(F.col("kind") == _WORDS).mapInArrow(_totals, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()

    asked = model.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "kind", "chunk")
    answers = asked.mapInArrow(_answer(depth, top), _ANSWER)

    none = lambda kind: F.lit(None).cast(kind)
    texts = rows.select("chunk", F.lit(_TEXTS).alias("kind"), none("binary").alias("keys"), none("binary").alias("value"), "doc_id", "held_out", "text")
    answers = answers.select("*", none("long").alias("doc_id"), none("boolean").alias("held_out"), none("string").alias("text"))
    parts = answers.unionByName(texts).repartitionById(chunks, "chunk").sortWithinPartitions("chunk", "kind")
    return parts.mapInArrow(_score_chunks(depth, *train), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (counts,) in _each(batches, "counts"):
        n = _unpack(counts)
        yield _batch("n long, v long", (int(n.sum()), int(np.count_nonzero(n))))


def _score_chunks(depth: int, n: int, v: int):
    to_log10 = math.log10(2)
    bottom = math.log10(n + 0.5 * (v + 1))
    unknown = math.log10(0.5) - bottom
    end = END_WORD.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = None
        keys: list[np.ndarray] = []
        values: list[np.ndarray] = []
        words: dict[bytes, float] = {}
        lookup = None
        for whole in batches:
            for batch in slices(whole, "text", PIECE_BYTES):
                chunk_of, kind_of = batch.column("chunk").to_numpy(), batch.column("kind").to_numpy()
                turns = np.flatnonzero((np.diff(chunk_of) != 0) | (np.diff(kind_of) != 0)) + 1
                for i, j in zip([0, *turns.tolist()], [*turns.tolist(), batch.num_rows]):
                    part, kind = batch.slice(i, j - i), kind_of[i]
                    if chunk_of[i] != chunk:
                        chunk, lookup = chunk_of[i], None
                        keys, values, words = [], [], {}
                    if kind == _TEXTS:
                        if lookup is None:
                            key, value = np.concatenate(keys), np.concatenate(values)
                            order = np.argsort(key)
                            lookup, keys, values = (key[order], value[order]), [], []
                            del key, value, order
                        for at in range(0, part.num_rows, PIECE_DOCS):
                            yield scored(part.slice(at, PIECE_DOCS), *lookup, words)
                        continue
                    for asked, value in _each([part], "keys", "value"):
                        if kind == _STRINGS:
                            keys.append(_unpack_sorted(asked))
                            values.append(_unpack(value, np.float32))
                        else:
                            c = _unpack(value)
                            logs = np.log10(c + 0.5) - bottom
                            words.update((w, x) for w, x, known in zip(_unpack_words(asked), logs.tolist(), (c > 0).tolist()) if known)

    def scored(batch: pa.RecordBatch, key: np.ndarray, value: np.ndarray, words: dict[bytes, float]) -> pa.RecordBatch:
        data, tokens, known, base = [], [], [], []
        for text in batch.column("text").to_pylist():
            found, raw = normal_bytes(text)
            data.append(raw)
            found.append(end)
            got = [x for x in map(words.get, found) if x is not None]
            tokens.append(len(found))
            known.append(len(got))
            base.append(math.fsum(got) + (len(found) - len(got)) * unknown)
        size = np.array([len(x) for x in data])
        total = np.zeros(len(data))
        for strings, doc in byte_strings(data, depth):
            # sorted with their documents' numbers, so that each string is looked up once, in order
            both = (strings.view(np.uint64) << np.uint64(8)) | doc.astype(np.uint64)
            both.sort()
            strings = (both >> np.uint64(8)).view(np.int64)
            first = _firsts(strings)
            bits = np.repeat(value[np.searchsorted(key, strings[first])].astype(float), np.diff(first, append=len(strings)))
            total += np.bincount((both & np.uint64(255)).astype(np.int64), bits, minlength=len(data))
        columns = [batch.column("doc_id"), batch.column("held_out"), *(pa.array(x, pa.int64()) for x in (tokens, known, [n] * len(data))), pa.array(base, pa.float64()), pa.array(total * to_log10), pa.array(-total / size)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    return run
