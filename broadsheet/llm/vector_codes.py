"""Compression of vectors to codes, a byte a part, with codebooks learnt by exact k-means in integers.

A component x becomes floor(4096 x).  Vectors are cut into equal parts; each part
position has a codebook, which starts as that part of the vectors with the smallest
ids and is refined by rounds of nearest entry (ties to the lower index) and
componentwise floor of the mean.  Entries that nothing uses stay.

Assignment uses the adaptive bounds of Drake and Hamerly.  For every part a vector
keeps its entry, an upper bound on the distance to it, its ``b`` next entries with
lower bounds, and one outer bound for all others.  When entries move, bounds move by
as much; what they still prove costs no distances.  Where they don't, the part is
verified in integers: first against its own entry, then against as many of its listed
entries as the bounds leave open, last against all.  Bounds are rounded outwards and
compared strictly, so that codes are those of the plain method, ties included.  ``b``
starts at a quarter of the entries and shrinks to what the last round used, an eighth
at least.

Vectors and bounds are one table, written to the shared folder each round, so a lost
executor costs its part of a round; the table of the round before then goes.  Sums are
made in each task and added by Spark: what reaches the driver are codebooks.

Defined results: vectors that are null, empty, or hold null or non-finite components are
dropped, and so are those of another length than the kept vector with the smallest id.
Of equal ids the smaller vector comes first; null ids come last.  Fewer vectors than
entries make a codebook of so many entries.  Repeated rows have a result each.  An empty
table gives an empty one.  Components beyond +-32,767, whose squared distances would not
fit in 64 bits, and lengths that the parts don't divide raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, drop_stored, stored

SCALE = 4096
#: Components of greater size could overflow sums of squares over all parts.
MOST = 32_767
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Numbers compared at once in a task.
_BLOCK = 1 << 22
_STATE = "entry binary, near binary, bounds binary, used binary"


@dataclass
class Codes:
    """Coded vectors (``id``, ``label``, ``code``, ``error``) and the codebooks they point into (part, entry, component)."""

    rows: DataFrame
    books: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.books.ravel()).encode()).hexdigest()


def _up(x: np.ndarray) -> np.ndarray:
    """As 32 bits, not below."""
    y = x.astype(np.float32)
    return np.where(y < x, np.nextafter(y, np.float32(np.inf)), y)


def _down(x: np.ndarray) -> np.ndarray:
    """As 32 bits, not above."""
    y = x.astype(np.float32)
    return np.where(y > x, np.nextafter(y, np.float32(-np.inf)), y)


def _root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


_SLACK = 1e-9  # above what rounding of roots and sums of doubles can be


class Bounds:
    """What is known of the parts of some vectors: entry, upper bound, near entries with lower bounds, outer bound."""

    def __init__(self, entry: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray, outer: np.ndarray):
        self.entry, self.upper, self.near, self.lower, self.outer = entry, upper, near, lower, outer
        #: How many listed entries were looked at; one more than there are for a look at all.
        self.used = np.zeros(len(entry), np.uint8)

    @classmethod
    def unknown(cls, n: int, b: int) -> Bounds:
        zero = np.zeros(n)
        return cls(np.zeros(n, np.int64), zero + np.inf, np.zeros((n, b), np.int64), np.zeros((n, b)), zero - np.inf)

    def moved(self, by: np.ndarray, b: int) -> None:
        """Entries have moved: ``by`` holds, for each part here, upper bounds of how far each of its entries has; ``b`` near ones stay listed."""
        row = np.arange(len(self.entry))
        self.upper = (self.upper + by[row, self.entry]) * (1 + _SLACK)
        self.lower = self.lower - by[row[:, None], self.near]
        self.outer = self.outer - by.max(axis=1)
        if b < self.near.shape[1]:
            self.outer = np.minimum(self.outer, self.lower[:, b:].min(axis=1))
            self.near, self.lower = self.near[:, :b], self.lower[:, :b]

    def open(self) -> np.ndarray:
        """How many of the near entries may be as close as the own one; one more than there are if others may be, too."""
        rest = np.minimum.accumulate(np.column_stack([self.lower, self.outer])[:, ::-1], axis=1)[:, ::-1]
        return (self.upper[:, None] >= rest).sum(axis=1)

    def verify(self, parts: np.ndarray, books: np.ndarray) -> None:
        """Makes every entry the nearest; ``parts`` are the integers of each part, ``books`` the codebook for each."""
        n, b, k = len(parts), self.near.shape[1], books.shape[1]
        row = np.flatnonzero(self.open() > 0)
        own = ((parts[row] - books[row, self.entry[row]]) ** 2).sum(axis=1)
        self.upper[row] = _root(own) * (1 + _SLACK)
        level = np.zeros(n, np.int64)
        level[row] = self.open()[row]
        self.used = level.astype(np.uint8)
        for z in range(1, b + 1):
            at = np.flatnonzero(level == z)
            if len(at):
                ids = np.column_stack([self.entry[at], self.near[at, :z]])
                square = ((parts[at][:, None, :] - books[at[:, None], ids]) ** 2).sum(axis=2)
                order = np.lexsort((ids, square), axis=1)
                ids, square = np.take_along_axis(ids, order, 1), np.take_along_axis(square, order, 1)
                self.entry[at], self.upper[at] = ids[:, 0], _root(square[:, 0]) * (1 + _SLACK)
                self.near[at, :z], self.lower[at, :z] = ids[:, 1:], _root(square[:, 1:]) * (1 - _SLACK)
        at = np.flatnonzero(level > b)
        if len(at):
            square = ((parts[at][:, None, :] - books[at]) ** 2).sum(axis=2)
            order = np.argsort(square, axis=1, kind="stable")
            square = np.take_along_axis(square, order, 1)
            self.entry[at], self.upper[at] = order[:, 0], _root(square[:, 0]) * (1 + _SLACK)
            self.near[at], self.lower[at] = order[:, 1 : b + 1], _root(square[:, 1 : b + 1]) * (1 - _SLACK)
            self.outer[at] = _root(square[:, b + 1]) * (1 - _SLACK) if b + 1 < k else np.inf


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), -1)


def _binary(rows: np.ndarray) -> pa.Array:
    """An array's rows as binary values."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(rows.tobytes())])


def _unpacked(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _assign(table: DataFrame, books: np.ndarray, before: np.ndarray | None, b_was: int, b: int) -> DataFrame:
    """The table with entries and bounds for ``books``; ``before`` are the books that its bounds are for, if it has any."""
    parts, k, width = books.shape
    moved = None if before is None else _root(((books - before) ** 2).sum(axis=2)) * (1 + _SLACK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, _BLOCK // (parts * k * width))
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                batch = whole.slice(i, step)
                n = batch.num_rows
                v = _vectors(batch.column("v")).reshape(n * parts, width)
                part = np.tile(np.arange(parts), n)
                if moved is None:
                    known = Bounds.unknown(n * parts, b)
                else:
                    bounds = _unpacked(batch.column("bounds"), np.float32).reshape(n * parts, b_was + 2).astype(np.float64)
                    near = _unpacked(batch.column("near"), np.uint8).reshape(n * parts, b_was).astype(np.int64)
                    known = Bounds(_unpacked(batch.column("entry"), np.uint8).ravel().astype(np.int64), bounds[:, 0], near, bounds[:, 2:], bounds[:, 1])
                    known.moved(moved[part], b)
                known.verify(v, books[part])
                bounds = np.column_stack([_up(known.upper), _down(known.outer), _down(known.lower)]).astype(np.float32)
                state = [known.entry.astype(np.uint8).reshape(n, parts), known.near.astype(np.uint8).reshape(n, parts * b), bounds.reshape(n, parts * (b + 2)), known.used.reshape(n, parts)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "v")), *map(_binary, state)], names=["id", "label", "v", "entry", "near", "bounds", "used"])

    label = table.schema["label"].dataType.simpleString()
    return table.mapInArrow(run, f"id long, label {label}, v array<int>, {_STATE}")


def _means(table: DataFrame, books: np.ndarray) -> tuple[np.ndarray, int]:
    """The books with their entries moved to the means of their parts, and the most listed entries that a part looked at."""
    parts, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, used = np.zeros((parts * k, width), np.int64), np.zeros(parts * k, np.int64), 0
        for batch in batches:
            if batch.num_rows:
                slot = (_unpacked(batch.column("entry"), np.uint8) + np.arange(parts) * k).ravel()
                v = _vectors(batch.column("v")).reshape(len(slot), width)
                order = np.argsort(slot, kind="stable")
                first = np.flatnonzero(np.diff(slot[order], prepend=-1))
                total[slot[order][first]] += np.add.reduceat(v[order], first, axis=0)
                count += np.bincount(slot, minlength=parts * k)
                used = max(used, int(_unpacked(batch.column("used"), np.uint8).max()))
        full = np.flatnonzero(count)
        if len(full):
            sums = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1) * width, pa.int32()), pa.array(total[full].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(count[full]), sums, pa.array(np.full(len(full), used))], names=["slot", "n", "sums", "used"])

    made = table.mapInArrow(run, "slot long, n long, sums array<long>, used long")
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    sums = made.groupBy("slot").agg(exact(F.col("n")).alias("n"), F.array(*[exact(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums"), F.max("used").alias("used"))
    out, most = books.reshape(parts * k, width).copy(), 0
    for r in sums.collect():  # a row an entry
        out[r["slot"]] = [int(s) // int(r["n"]) for s in r["sums"]]
        most = max(most, r["used"])
    return out.reshape(books.shape), most


def _final(table: DataFrame, books: np.ndarray) -> DataFrame:
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry = _unpacked(batch.column("entry"), np.uint8) if batch.num_rows else np.zeros((0, parts), np.uint8)
            v = _vectors(batch.column("v")).reshape(batch.num_rows, parts, width) if batch.num_rows else np.zeros((0, parts, width))
            error = ((v - books[np.arange(parts), entry]) ** 2).sum(axis=(1, 2)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([e.tobytes().hex() for e in entry], pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    label = table.schema["label"].dataType.simpleString()
    return table.mapInArrow(run, f"id long, label {label}, code string, error long")


def _integers(vector: Column) -> Column:
    small = lambda x: F.abs(x) <= MOST
    whole = lambda x: F.floor(x.cast("double") * SCALE).cast("int")
    return F.transform(vector, lambda x: F.when(small(x), whole(x)).otherwise(F.raise_error(F.lit(f"components beyond +-{MOST} cannot be coded")).cast("int")))


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes:
    """Codes of all vectors, and the codebooks; ``label_col`` is passed on as ``label``."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must lie in 1..256, so that an index fits in a byte")
    vector = F.col(vector_col)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    label = F.col(label_col) if label_col else F.lit(None).cast("string")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), vector.alias("v")).where((F.size("v") > 0) & ~F.exists("v", bad))
    table = stored(rows.withColumn("v", _integers(F.col("v"))))
    first = table.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(1).collect()
    width = len(first[0]["v"]) if first else parts
    if width % parts:
        raise ValueError(f"{parts} parts don't divide vectors of {width} components")
    base, table = table, table.where(F.size("v") == width)
    first = table.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    books = np.array([r["v"] for r in first], np.int64).reshape(-1, parts, width // parts).swapaxes(0, 1).copy()
    if not first:
        return Codes(base.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).where("false"), books)
    k = len(first)
    b_was = b = min(k - 1, max(1, k // 4))
    before = None
    for step in range(rounds + 1):
        old, table = table, stored(_assign(table, books, before, b_was, b))
        drop_stored(old if step else base)
        if step == rounds:
            break
        before = books
        books, used = _means(table, books)
        b_was, b = b, min(b, max(used, k // 8, 1))
    return Codes(_final(table, books), books)


def summary(codes: Codes) -> DataFrame:
    """Codes with their errors, the error of each label, and the digest of the codebooks."""
    rows = stored(codes.rows)
    labels = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    out = rows.join(broadcast_if_small(labels), rows["label"].eqNullSafe(labels["of"]))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))
