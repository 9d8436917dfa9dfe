"""Packing documents into training windows by the online sum-of-squares rule.

Each task streams over its own partition and keeps a level array: ``count[f]``
is the number of open windows filled to ``f`` ids.  The rest of a document
(after its whole windows are cut off) goes to the fill level that makes the sum
of squared counts smallest.  A task holds at most ``MAX_OPEN`` open windows;
when that many are open, or the partition ends, the fullest are topped up with
cut pieces of the emptiest until one is left, which is cut at powers of two, so
that nothing needs padding.  No shuffle is needed: windows never span tasks.

Ids are those of the ``byte_bpe_50k.json`` vocabulary of the ``tokenizers``
library, without added special tokens; the ranks of the same vocabulary are
run by ``tiktoken``, which is about four times as fast and yields the same ids
(``tests/llm/test_corpus.py`` compares them).  The vocabulary's own special
token is one id wherever a text holds it, as in ``tokenizers``.

Defined results: a null or empty text is its end id alone.  Repeated rows are
packed each.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1024
END_ID = 0
MAX_OPEN = 4096
#: The added token of the vocabulary.
SPECIAL = {"<|endoftext|>": 50256}

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.cache
def tokenizer(name: str = "byte_bpe_50k.tiktoken"):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


#: White space so long that the pattern's search for its end must not be left to a stack.
_LONG_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{4096,}")


def encode(text: str) -> list[int]:
    """The ids of a text, as the vocabulary's own tokenizer has them.

    By the vocabulary's pattern white space before a word is one piece without its
    last character, and at the end, or before a special token, one piece.  So long white space is
    cut out as that piece, and what stands before and after it can't tell the difference.
    """
    bpe, ids, at = tokenizer(), [], 0
    for m in _LONG_SPACE.finditer(text):
        start, end = m.span()
        if end < len(text) and not any(text.startswith(s, end) for s in SPECIAL):
            end -= 1
        ids += bpe.encode(text[at:start], allowed_special="all")
        ids += bpe._encode_single_piece(text[start:end])
        at = end
    return ids + bpe.encode(text[at:], allowed_special="all")


def choose_level(count: np.ndarray, size: int, window: int) -> int:
    """The fill level, 0 for a new window, where ``size`` ids raise the sum of squares least.

    Taking level f to f + size changes the sum by
    ``(1 - 2 count[f]) + (1 + 2 count[f + size])``; full and new windows don't count.
    Ties go to the fullest level.
    """
    top = window - size
    gain = 2 * (count[size : window + 1] - count[: top + 1])
    gain[1:] += 2
    gain[0] += 1 + 2 * count[0]  # a new window has no level to leave
    gain[top] -= 2 * count[window] + 1  # a full one reaches none
    gain[1:][count[1 : top + 1] == 0] = np.iinfo(np.int64).max
    return top - int(np.argmin(gain[::-1]))


class Packer:
    """The open windows of one task; ``emit(window number, pieces)`` gets each closed one."""

    def __init__(self, emit, window: int = WINDOW, max_open: int = MAX_OPEN, trim=lambda doc, start: doc):
        """``trim`` may free what ``doc`` holds of its ids before ``start``."""
        self.emit, self.window, self.max_open, self.trim = emit, window, max_open, trim
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(window + 1)]
        self.n_open = 0

    def add(self, doc: tuple, n: int) -> None:
        """``doc`` is carried along; its ids are 0 to ``n`` - 1."""
        whole = n - n % self.window
        for start in range(0, whole, self.window):
            self.emit([(doc, start, self.window)])
        size = n - whole
        if not size:
            return
        level = choose_level(self.count, size, self.window)
        pieces = self.open[level].pop() if level else []
        if level:
            self.count[level] -= 1
            self.n_open -= 1
        pieces.append((self.trim(doc, whole), whole, size))
        self._put(pieces, level + size)
        if self.n_open >= self.max_open:
            self.close()

    def _put(self, pieces: list[tuple], level: int) -> None:
        if level == self.window:
            self.emit(pieces)
        else:
            self.open[level].append(pieces)
            self.count[level] += 1
            self.n_open += 1

    def close(self) -> None:
        """Empties the level array: fullest windows are topped up with pieces of the emptiest."""
        waiting = [pieces for level in self.open for pieces in level]  # emptiest first
        self.open = [[] for _ in range(self.window + 1)]
        self.count[:] = 0
        self.n_open = 0
        first, last, spare = 0, len(waiting) - 1, []  # spare: pieces to cut from
        while first <= last or spare:
            if first > last:
                self._tail(spare)
                return
            pieces, fill = waiting[last], sum(p[2] for p in waiting[last])
            last -= 1
            while fill < self.window:
                if not spare:
                    if first > last:
                        self._tail(pieces)
                        return
                    spare = waiting[first][::-1]
                    first += 1
                doc, start, size = spare.pop()
                part = min(size, self.window - fill)
                pieces.append((doc, start, part))
                fill += part
                if part < size:
                    spare.append((doc, start + part, size - part))
            self.emit(pieces)

    def _tail(self, pieces: list[tuple]) -> None:
        """What is left is less than a window: it is cut into powers of two, largest first."""
        left = pieces[::-1]
        fill = sum(p[2] for p in pieces)
        while fill:
            room = take = 1 << (fill.bit_length() - 1)
            out = []
            while room:
                doc, start, size = left.pop()
                part = min(size, room)
                out.append((doc, start, part))
                room -= part
                if part < size:
                    left.append((doc, start + part, size - part))
            self.emit(out)
            fill -= take


def _pack_partition(batches: Iterator[pa.RecordBatch], window: int, max_open: int) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 33
    rows: list[list] = [[] for _ in range(7)]
    made = 0

    def emit(pieces) -> None:
        nonlocal made
        at = 0
        for (doc_id, n, ids, first), start, size in pieces:
            data = ids[4 * (start - first) : 4 * (start - first + size)]
            for column, value in zip(rows, (doc_id, start, size, zlib.crc32(data), n, base + made, at)):
                column.append(value)
            at += size
        made += 1

    def flush() -> pa.RecordBatch:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=names)
        for column in rows:
            column.clear()
        return out

    def trim(doc: tuple, start: int) -> tuple:
        doc_id, n, ids, first = doc
        return doc_id, n, ids[4 * (start - first) :], start

    packer = Packer(emit, window, max_open, trim)
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = encode(text.as_py() or "")
            ids.append(END_ID)
            packer.add((doc_id, len(ids), np.asarray(ids, dtype="<u4").tobytes(), 0), len(ids))
            if len(rows[0]) >= 8192:
                yield flush()
    packer.close()
    yield flush()


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, max_open: int = MAX_OPEN) -> DataFrame:
    """One row per piece: document, place in the document, sequence and place in it."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(lambda batches: _pack_partition(batches, window, max_open), SCHEMA)
