"""Vectorised hashes of words and shingles, straight from Arrow string buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_S33 = np.uint64(33)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> _S33)
    x *= _M1
    x ^= x >> _S33
    x *= _M2
    x ^= x >> _S33
    return x


#: A random number for each (place in the word modulo 64, byte).
_TABLE = mix64(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * _ODD)
_SEGMENT = 1 << 20


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most_bytes`` of text (or one row)."""
    _, offs = buffers(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most_bytes, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs outside ASCII white space, within a text)."""
    space = SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offs] = True
    before = np.ones(len(data), dtype=bool)
    before[1:] = space[:-1]
    after = np.ones(len(data), dtype=bool)
    after[:-1] = space[1:]
    return np.flatnonzero(~space & (before | edge[:-1])), np.flatnonzero(~space & (after | edge[1:])) + 1


def hash_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and where each text's words begin (one more at the end)."""
    starts, ends = word_bounds(data, offs)
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SEGMENT)))
        lo, size = starts[i], ends[i:j] - starts[i:j]
        first = starts[i:j] - lo
        # the words of this segment, one after the other without what lies between
        begin = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(begin, size)
        part = data[lo + place + np.repeat(first, size)]
        value = _TABLE[((place & 63) << 8) | part]
        far = np.flatnonzero(place >= 64)
        if len(far):
            value[far] = mix64(value[far] + (place[far] >> 6).astype(np.uint64) * _ODD)
        out[i:j] = np.add.reduceat(value, begin)
        i = j
    return mix64(out), np.searchsorted(starts, offs)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of the ``k``-word shingles of one text, sorted; a shorter text is one shingle."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    h = words[:n].copy()
    for j in range(1, k):
        h *= _ODD
        h += words[j : j + n]
        h ^= h >> _S33
    return np.unique(mix64(h))
