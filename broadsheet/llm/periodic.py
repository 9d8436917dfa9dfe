"""Periodic runs of words: passages that repeat themselves over and over.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q``
apart are the same) of at least ``max(6, 4 q)`` words that no neighbouring word
extends.  It is found by dynamic programming on the diagonals of the table that
compares a text with itself: the diagonal of lag ``q`` is active at a word while
the word ``q`` before is the same one, its length grows word by word, and the run
is emitted as soon as the diagonal ends.

The table is sparse: a word only continues diagonals of its earlier occurrences.
Of these the nearest is enough, at each scale.  A diagonal of lag ``q`` matters
only if it becomes part of a run of ``4 q`` words, and inside such a run the
nearest earlier occurrence of any ``k >= q`` words is ``q`` back: one at a smaller
lag would, with ``q``, give the run a smaller period.  So with ``k`` the power of
two from ``q`` up, words are looked up ``k`` at a time, and stretches in which the
nearest earlier occurrence keeps its lag in ``(k / 2, k]`` are just the diagonals
of these lags that make runs.  Strings of ``2 k`` words are named by the names of
their halves, and only places whose ``k`` words occur twice are looked at again,
so ordinary texts cost two or three scales, and any text at most as many as its
length has bits.  Lags that no run can have are never active.

Words are told apart exactly (dictionary codes, no hashes).  A text is a row of
one task; texts are taken in slices of some megabytes, a longer one alone.

Defined results: a null or empty text, or one of white space, has no words and no
runs.  Null ids are passed on.  Repeated rows have a result each.  An empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD
from .hashing import slices

#: Least words of a run, and least periods in it.
LEAST_WORDS, LEAST_PERIODS = 6, 4

RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and where each text's words begin (one more at the end)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, at = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    full = pc.not_equal(words, "")
    begins = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[at]
    return words.filter(full), begins


def find_runs(words: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (in ``words``), length and period of all runs; ``words`` are the codes of several texts' words, cut at ``begins``.

    They come by start, then period.
    """
    text_of = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    end_of = begins[1:][text_of]
    longest = int(np.diff(begins).max(initial=0))
    found: list[np.ndarray] = []
    # places whose k words occur elsewhere in their text, ascending, and numbers of these k words
    places, k = np.arange(len(words)), 1
    key = _pairs(text_of, words.astype(np.int64))
    at = np.empty(len(words) + 1, np.int64)
    while len(places) and k <= 2 * max(1, longest // LEAST_PERIODS):
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        later, earlier = order[1:][same], order[:-1][same]
        lag = np.zeros(len(places), np.int64)
        lag[later] = places[later] - places[earlier]
        found.append(_ended(places, lag, k))
        again = np.zeros(len(places), bool)
        again[later] = again[earlier] = True
        number = np.empty(len(places), np.int64)
        number[order] = np.concatenate([[0], np.cumsum(~same)])
        # twice as many: k words here and the k words after them, both of which occur elsewhere
        here = np.flatnonzero(again)
        at[:] = -1
        at[places[here]] = here
        second = at[np.minimum(places[here] + k, len(words))]
        fits = (second >= 0) & (places[here] + 2 * k <= end_of[places[here]])
        here, second = here[fits], second[fits]
        places, key = places[here], _pairs(number[here], number[second])
        k *= 2
    runs = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    runs = runs[:, np.lexsort((runs[2], runs[0]))]
    return runs[0], runs[1], runs[2]


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for each pair of small numbers."""
    return a * (int(b.max(initial=0)) + 1) + b


def _ended(places: np.ndarray, lag: np.ndarray, k: int) -> np.ndarray:
    """Of stretches of consecutive places with one lag in ``(k / 2, k]``: start, length and period of those that are runs."""
    active = (lag > k // 2) & (lag <= k)
    follows = np.zeros(len(places), bool)
    follows[1:] = active[1:] & active[:-1] & (lag[1:] == lag[:-1]) & (places[1:] == places[:-1] + 1)
    first = np.flatnonzero(active & ~follows)
    if not len(first):
        return np.zeros((3, 0), np.int64)
    matched = np.add.reduceat(active.astype(np.int64), first)  # what isn't active adds nothing
    period = lag[first]
    length = matched + k - 1 + period
    enough = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    return np.stack([places[first] - period, length, period])[:, enough]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    ``collapsed`` is the text's words joined by one space, without those that any run
    contains after its first period.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words, begins = _split(batch.column("text"))
                codes = words.dictionary_encode().indices.to_numpy() if len(words) else np.zeros(0, np.int64)
                start, length, period = find_runs(codes, begins)
                owner = np.searchsorted(begins, start, "right") - 1
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, start + period, 1)
                np.add.at(gone, start + length, -1)
                kept = np.cumsum(gone[:-1]) == 0
                kept_at = np.concatenate([[0], np.cumsum(kept)])[begins]
                lists = pa.ListArray.from_arrays(pa.array(kept_at, pa.int32()), words.filter(pa.array(kept)))
                fields = [pa.array(x, pa.int64()) for x in (start - begins[owner], length, period)]
                runs = pa.StructArray.from_arrays(fields, names=["start", "length", "period"])
                offsets = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(np.diff(begins), pa.int64()), pa.ListArray.from_arrays(offsets, runs), pc.binary_join(lists, " ")],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared in whole numbers; ties go to the first in order."""
    beats = lambda r, best: r["length"] * best["period"] > best["length"] * r["period"]
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, r: F.when(best.isNull() | beats(r, best), r).otherwise(best))


def listed(runs: Column) -> Column:
    """Every run's ``start,length,period`` on a line of its own."""
    line = lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))
    return F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), "")


def summary(found: DataFrame) -> DataFrame:
    """Counts, the strongest run and digests of what ``scan`` found."""
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def looped(docs: DataFrame) -> DataFrame:
    """``documents`` with every tenth text (by the checksum of its id) made to repeat a stretch of its own words to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    n, g = F.size("words").cast("long"), F.floor(F.col("h") / 10)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - F.col("a")) / (3 + g % 8))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p")))
    repeated = F.array_join(F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", place(i.cast("long")).cast("int"))), " ")
    chosen = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    # behind generators, so that words, a and p are computed once
    once = lambda df: df.select(F.inline(F.array(F.struct("*"))))
    chosen = once(chosen)
    chosen = once(chosen.withColumn("a", F.when(n > 0, a)))
    chosen = once(chosen.withColumn("p", F.when(n > 0, p)))
    return chosen.select("doc_id", F.when(F.coalesce(n > 0, F.lit(False)), repeated).otherwise(F.col("text")).alias("text"))
