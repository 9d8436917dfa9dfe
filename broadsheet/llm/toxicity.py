"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

A text's features are the distinct words it has and their beginnings of four to
six characters (for inflected forms), hashed.  The model has one weight per
feature, shared by all thresholds: ``P(grade >= k) = 1 / (1 + exp(theta_k - x.w))``
with ``theta_1 < theta_2 < ...``.  The output is each text's expected grade and,
where ``P(grade >= 1)`` reaches the model's cut, the decision that it is toxic.  The
cut is the least that at most ``FALSE_SHARE`` of the clean training texts reach, within
``LEAST_CUT`` and ``MOST_CUT``.

The model is fitted on at most ``MAX_TRAIN`` labelled documents, those with the
smallest hashed ids.  Features that
fewer than ``MIN_DOCS`` of them have, or that say little about the label, are
left out, so that a text's length adds no noise; of the others the model has the
``MAX_FEATURES`` that say most, which bounds what goes to every task.  Grades come
from the labels alone: where these only tell toxic from not there is one threshold,
and the expected grade is the probability of being toxic.

Defined results: a null or empty text has no features and gets the grade that
the thresholds alone give; with no labels, or of one class only, every text has
grade 0.  Repeated rows get equal results.  Labels of unknown documents, or
null, are not used; of several labels of a document the worst counts, and of several
texts of an id the model learns from the first in order.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .hashing import LOWER, buffers, mix64, slices, word_bounds

MAX_TRAIN = 20_000
MIN_DOCS = 4
MAX_FEATURES = 8_192
FALSE_SHARE, LEAST_CUT, MOST_CUT = 0.001, 0.02, 0.5
STEMS = (4, 5, 6)
#: A feature is kept if its log odds by label lie this far from the rest.
LEAST_ODDS = 3.0

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(0x80, 256)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature hashes of each text, one after the other, and where each text's begin.

    A word here is a run of ASCII letters and characters outside ASCII, so that
    punctuation around it doesn't count.
    """
    data, offs = buffers(texts)
    data = LOWER[data]
    letters = np.where(_LETTER[data], data, np.uint8(0x20))
    starts, ends = word_bounds(letters, offs)
    size = ends - starts
    doc = np.searchsorted(offs, starts, "right") - 1
    found, docs = [], []
    longest = int(size.max(initial=0))
    # a beginning's hash follows from the one that is a byte shorter
    h = np.full(len(starts), _ODD)
    alive = np.arange(len(starts))
    for n in range(1, longest + 1):
        h = mix64(h + letters[starts[alive] + (n - 1)].astype(np.uint64) * _ODD)
        whole = size[alive] == n
        found.append(h[whole] ^ np.uint64(1))
        docs.append(doc[alive[whole]])
        if n in STEMS:
            found.append(h[~whole])
            docs.append(doc[alive[~whole]])
        alive, h = alive[~whole], h[~whole]
        if not len(alive):
            break
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    h, doc = np.concatenate(found), np.concatenate(docs)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[first], doc[first]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


@dataclass
class Model:
    """``keys`` (sorted) and ``weights`` of the features; ``theta``, one threshold a grade above 0; ``cut``."""

    keys: np.ndarray
    weights: np.ndarray
    theta: np.ndarray
    cut: float = MOST_CUT

    def score(self, h: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The linear score of each text."""
        total = np.zeros(len(h) + 1)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            total[1:] = np.cumsum(np.where(self.keys[at] == h, self.weights[at], 0.0))
        return total[begins[1:]] - total[begins[:-1]]

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each text and k = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.theta[None, :] - score[:, None], -500, 500)))


def fit(rows: np.ndarray, columns: np.ndarray, n_features: int, grade: np.ndarray, penalty: float = 0.1, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by penalised maximum likelihood (Adam on all rows).

    ``rows`` and ``columns`` name the features that are there.  Thresholds
    stay in order because each is the one below plus an exponential.
    """
    n, top = len(grade), int(grade.max())
    w = np.zeros(n_features)
    raw = np.zeros(top)
    share = np.array([(grade >= k).mean() for k in range(1, top + 1)]).clip(1e-4, 1 - 1e-4)
    theta = -np.log(share / (1 - share))
    raw[0], raw[1:] = theta[0], np.log(np.maximum(np.diff(theta), 1e-2))
    m, v = np.zeros(n_features + top), np.zeros(n_features + top)
    for step in range(1, rounds + 1):
        theta = raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])
        score = np.bincount(rows, w[columns], minlength=n)
        p = 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -30, 30)))
        p = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], axis=1)
        i = np.arange(n)
        lower, upper = p[i, grade], p[i, grade + 1]
        likely = np.maximum(lower - upper, 1e-12)
        d_lower, d_upper = lower * (1 - lower) / likely, upper * (1 - upper) / likely
        g_theta = np.zeros(top + 2)
        np.add.at(g_theta, grade, d_lower)
        np.add.at(g_theta, grade + 1, -d_upper)
        g_theta = g_theta[1:-1]
        g_raw = np.empty(top)
        g_raw[0] = g_theta.sum()
        for k in range(1, top):
            g_raw[k] = g_theta[k:].sum() * np.exp(raw[k])
        g_w = np.bincount(columns, (d_upper - d_lower)[rows], minlength=n_features) + penalty * w
        g = np.concatenate([g_w, g_raw])
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        change = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w -= change[:n_features]
        raw -= change[n_features:]
    return w, raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])


def graded(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """(``id``, ``label``): one grade (0, 1, 2, ...) for each labelled document."""
    grade = F.col(label_col).cast("int").alias("label")
    return labels.select(F.col(id_col).alias("id"), grade).dropna().groupBy("id").agg(F.max("label").alias("label"))


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", max_train: int = MAX_TRAIN) -> Model:
    """Fits the model on the labelled documents with the smallest hashed ids, ``max_train`` at most."""
    known = F.broadcast(graded(labels, id_col, label_col).orderBy(F.xxhash64("id"), "id").limit(max_train))
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    sample = text.join(known, "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                h, begins = features(batch.column("text"))
                found = pa.array([h[i:j].tobytes() for i, j in zip(begins[:-1], begins[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), found], names=["id", "label", "found"])

    hashed = stored(sample.select("id", "label", "text").mapInArrow(run, "id long, label int, found binary"))
    # how many texts of each label have a feature: counted on the executors
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("found")]
            label = np.repeat(np.array(batch.column("label").to_pylist(), np.int32), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)), pa.array(label > 0)], names=["feature", "toxic"])

    size = hashed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("label") > 0).cast("int")), F.lit(0)).alias("toxic")).first()
    n, bad = size["n"], size["toxic"]
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), np.array([50.0]))
    if not bad or bad == n:
        return nothing
    spread_rows = hashed.mapInArrow(spread, "feature long, toxic boolean")
    counts = spread_rows.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("toxic").cast("int")).alias("bad")).where(F.col("n") >= MIN_DOCS)
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("n") - F.col("bad") + 0.5) / (n - bad + 1.0))
    counts = counts.withColumn("odds", odds).where(F.abs("odds") >= LEAST_ODDS)
    # information about the label, roughly: odds times the square root of the count
    kept = counts.orderBy(F.desc(F.abs("odds") * F.sqrt("n")), "feature").limit(MAX_FEATURES).select("feature", "odds").toPandas()
    if not len(kept):
        return nothing
    kept["feature"] = kept["feature"].to_numpy().view(np.uint64)
    kept = kept.sort_values("feature")
    keys = kept["feature"].to_numpy()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column("found"):
                h = np.frombuffer(x.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                out.append(at[keys[at] == h].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(out, pa.binary())], names=["id", "label", "found"])

    data = hashed.mapInArrow(reduce, "id long, label int, found binary").toArrow().sort_by("id")
    sets = [np.frombuffer(x.as_buffer(), np.int32) for x in data.column("found")]
    label = data.column("label").to_numpy()
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    columns = np.concatenate(sets)
    weights, theta = fit(rows, columns, len(keys), label.astype(np.int64))
    clean = 1 / (1 + np.exp(np.clip(theta[0] - np.bincount(rows, weights[columns], minlength=len(sets))[label == 0], -500, 500)))
    cut = np.nextafter(np.quantile(clean, 1 - FALSE_SHARE, method="higher"), 1.0) if len(clean) else MOST_CUT
    return Model(keys, weights, theta, float(np.clip(cut, LEAST_CUT, MOST_CUT)))


def score(docs: DataFrame, model: Model, id_col="doc_id", text_col="text", cut: float | None = None) -> DataFrame:
    """One row per document: id, ``p_toxic``, ``expected_severity``, ``grade`` (the likeliest), ``toxic``."""
    least = model.cut if cut is None else cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                p = model.at_least(model.score(*features(batch.column("text"))))
                each = -np.diff(np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], axis=1), axis=1)
                columns = [batch.column("doc_id"), pa.array(p[:, 0]), pa.array(p.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(p[:, 0] >= least)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "p_toxic", "expected_severity", "grade", "toxic"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, p_toxic double, expected_severity double, grade int, toxic boolean")


def reject_toxic(docs: DataFrame, model: Model, text_col="text", cut: float | None = None) -> DataFrame:
    """The documents that aren't toxic, with all their columns: a map over the rows, no join."""
    least = model.cut if cut is None else cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                p = model.at_least(model.score(*features(batch.column(text_col))))[:, 0]
                yield batch.filter(pa.array(p < least))

    return docs.mapInArrow(run, docs.schema)
