"""Near-duplicate documents by SimHash, searched by the generalised pigeonhole principle.

A document's fingerprint has 64 bits; a bit is set if it is set in over half the
hashes (XXH64 with seed 42) of its word shingles, repeats included.  Documents are
linked if their fingerprints differ in at most ``BITS`` bits, and a component is what
links connect.  Equal fingerprints count once.

Bits that go together, by the correlations over all fingerprints, are grouped into
``m`` partitions.  If a fingerprint q shares its thresholds t_i out so that the sum of
t_i + 1 is ``BITS`` + 1, each fingerprint linked to it is within t_i of it in some
partition (t_i = -1 passes a partition over).  Every q chooses its own thresholds by
dynamic programming over the partitions for the least of probes and estimated
candidates; estimates come from counts over all fingerprints of what pieces of at most
``PIECE`` bits hold, taken as independent.  q then probes a partition's values within
t_i of its own, in one join with the values of all smaller fingerprints, and candidates
are verified inside the join.  Whatever the estimates, the result is exact: they only decide costs.

A value that more than ``HOT`` fingerprints share is hot (families on one template) and
not probed, as its candidates grow with the square of the family.  Fingerprints that
have or would probe a hot value are linked through points between them instead.  All
within one bit of a point are linked to one another, so each goes to the least of its
65 points' holders; that is every link of at most two bits.  A link of three bits has a
point two bits from one end and one from the other; an end is looked up by its 2,016
points at two bits unless it is in the component that is largest under each of its hot
values, as then the other end is not.  So costs stay in proportion to the fingerprints,
at most 2,081 rows each, however large a family is.

Defined results: a null or empty text, or one of white space, has fingerprint zero and is
linked like any other.  A text of fewer words than a shingle is one shingle.  Rows with
null ids link like others; a component of null ids alone has no id.  Repeated rows are in
one component.  An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpoint, stored
from .components import components
from .hashing import LOWER, buffers, slices

#: Words of a shingle, and most bits in which linked fingerprints differ.
WORDS, BITS = 3, 3
SEED = 42
#: Bits of a piece whose values are counted, for estimates.
PIECE = 11
#: Fingerprints that may share a value of a partition and be compared with a probe: as many as a fingerprint has points.
HOT = 2081
_HASHES = 1 << 16


def _bits(fp: np.ndarray) -> np.ndarray:
    """A row of 64 zeros and ones for each fingerprint."""
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def simhash(text: bytes, words: int = WORDS) -> int:
    """The fingerprint of a lower-cased text."""
    found = text.split()  # at ASCII white space
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = ends - [len(w) + 1 for w in found]
    k = min(words, len(found))
    starts, ends = starts[: len(found) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist()
    n, digest = len(starts), xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _HASHES):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + _HASHES], ends[i : i + _HASHES])], np.uint64)
        ones += _bits(hashes).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(``id``, ``fp``) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                data, offs = buffers(batch.column("text"))
                raw, at = LOWER[data].tobytes(), offs.tolist()
                found = np.array([simhash(raw[a:b], words) for a, b in itertools.pairwise(at)], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def _column(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("fp").to_numpy().view(np.uint64)


# ------------------------------------------------------------------- the plan


def _together(fps: DataFrame) -> np.ndarray:
    """How often each two bits are both set, over all fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64), np.int64)
        for batch in batches:
            x = _bits(_column(batch)).astype(np.float64)
            total += (x.T @ x).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(64)), pa.array(total.tolist(), pa.list_(pa.int64()))], names=["bit", "n"])

    sums = fps.select("fp").mapInArrow(run, "bit long, n array<long>").groupBy("bit").agg(F.array(*[F.sum(F.get("n", F.lit(i))) for i in range(64)]).alias("n"))
    out = np.zeros((64, 64))
    for r in sums.collect():  # 64 rows
        out[r["bit"]] = r["n"]
    return out


def partitions(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """The bits in ``m`` groups of equal sizes, give or take one, each grown from its most correlated pair."""
    share = np.diag(together) / max(1, n)
    spread = np.sqrt(share * (1 - share))
    with np.errstate(divide="ignore", invalid="ignore"):
        corr = np.nan_to_num(np.abs((together / max(1, n) - np.outer(share, share)) / np.outer(spread, spread)))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(64)), []
    for i in range(m):
        size = (64 - sum(map(len, groups)) + m - i - 1) // (m - i)
        a, b = divmod(int(np.argmax(corr[np.ix_(left, left)])), len(left)) if len(left) > 1 else (0, 0)
        group = sorted({left[a], left[b]})
        while len(group) < size:
            rest = [x for x in left if x not in group]
            group.append(rest[int(np.argmax(corr[np.ix_(rest, group)].sum(axis=1)))])
        groups.append(sorted(group[:size]))
        left = [x for x in left if x not in groups[-1]]
    return groups


def _value(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for j, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)
    return out


class Plan:
    """Partitions and pieces of the bits, and how many fingerprints are how far from each value of a piece."""

    def __init__(self, groups: list[list[int]], bits: int):
        self.groups, self.bits = groups, bits
        self.pieces = [[g[i : i + PIECE] for i in range(0, len(g), PIECE)] for g in groups]
        self.far: list[list[np.ndarray]] = []
        self.n = 0
        self.masks = [_masks(len(g), bits) for g in groups]

    def count(self, fps: DataFrame, n: int) -> None:
        """Counts the values of all pieces, a bounded table, over all fingerprints."""
        flat = [p for group in self.pieces for p in group]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(flat), 1 << PIECE), np.int64)
            for batch in batches:
                fp = _column(batch)
                for i, p in enumerate(flat):
                    total[i] += np.bincount(_value(fp, p).astype(np.int64), minlength=1 << PIECE)
            at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(total[at])], names=["piece", "value", "n"])

        rows = fps.select("fp").mapInArrow(run, "piece long, value long, n long").groupBy("piece", "value").agg(F.sum("n").alias("n"))
        total = np.zeros((len(flat), 1 << PIECE))
        for r in rows.collect():  # at most 64 / PIECE times 2 ** PIECE rows
            total[r["piece"], r["value"]] = r["n"]
        far = []
        for counts, p in zip(total, flat):
            values, by = np.arange(1 << len(p)), np.zeros((self.bits + 1, 1 << len(p)))
            for mask, d in zip(*_masks(len(p), self.bits)):
                by[d] += counts[values ^ int(mask)]
            far.append(by)
        it = iter(far)
        self.far, self.n = [[next(it) for _ in group] for group in self.pieces], n

    def costs(self, fp: np.ndarray) -> np.ndarray:
        """(fingerprint, partition, units): probes and estimated candidates where t is units - 1."""
        out = np.zeros((len(fp), len(self.groups), self.bits + 2))
        for i, (pieces, far) in enumerate(zip(self.pieces, self.far)):
            at = np.zeros((self.bits + 1, len(fp)))
            at[0] = self.n
            for p, by in zip(pieces, far):
                share = by[:, _value(fp, p).astype(np.int64)] / max(1, self.n)
                at = np.stack([sum(at[e] * share[d - e] for e in range(d + 1)) for d in range(self.bits + 1)])
            probes = np.cumsum([math.comb(len(self.groups[i]), d) for d in range(self.bits + 1)])
            out[:, i, 1:] = (np.cumsum(at, axis=0) + probes[:, None]).T
        return out

    def thresholds(self, fp: np.ndarray) -> np.ndarray:
        """Units of each partition, a row a fingerprint: t + 1, so 0 passes it over; they add up to ``bits`` + 1."""
        cost, units = self.costs(fp), self.bits + 1
        best = np.full((len(fp), units + 1), np.inf)
        best[:, 0] = 0
        choices = []
        for i in range(len(self.groups)):
            ways = np.stack([np.column_stack([np.full((len(fp), u), np.inf), best[:, : units + 1 - u] + cost[:, i, u : u + 1]]) for u in range(units + 1)])
            choices.append(ways.argmin(axis=0))
            best = ways.min(axis=0)
        left, out = np.full(len(fp), units), np.zeros((len(fp), len(self.groups)), np.int64)
        for i in reversed(range(len(self.groups))):
            out[:, i] = choices[i][np.arange(len(fp)), left]
            left -= out[:, i]
        return out

    def keys(self, fp: np.ndarray, i: int) -> np.ndarray:
        return np.uint64(i << 40) | _value(fp, self.groups[i])


def _masks(width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All masks of at most ``most`` of ``width`` bits, and how many they have."""
    found = [(sum(1 << b for b in c), d) for d in range(most + 1) for c in itertools.combinations(range(width), d)]
    return np.array([m for m, _ in found], np.uint64), np.array([d for _, d in found])


def _spread(fps: DataFrame, keys_of) -> DataFrame:
    """(``key``, ``fp``): the keys that ``keys_of`` gives for fingerprints, as arrays of keys and of the rows they belong to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                fp = _column(whole.slice(i, 2048))
                for key, row in keys_of(fp):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp[row].view(np.int64))], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def _index_keys(plan: Plan):
    def keys(fp: np.ndarray):
        for i in range(len(plan.groups)):
            yield plan.keys(fp, i), np.arange(len(fp))

    return keys


def _probe_keys(plan: Plan):
    def keys(fp: np.ndarray):
        units = plan.thresholds(fp)
        for i in range(len(plan.groups)):
            masks, weight = plan.masks[i]
            for u in range(1, plan.bits + 2):
                row = np.flatnonzero(units[:, i] == u)
                if len(row):
                    near = masks[weight < u]
                    yield (plan.keys(fp[row], i)[:, None] ^ near[None, :]).ravel(), np.repeat(row, len(near))

    return keys


def _points(distances: tuple[int, ...]):
    """Keys: the points so many bits away."""
    masks, weight = _masks(64, max(distances))
    masks = masks[np.isin(weight, distances)]

    def keys(fp: np.ndarray):
        for i in range(0, len(fp), 256):
            yield (fp[i : i + 256, None] ^ masks[None, :]).ravel(), np.repeat(np.arange(i, min(len(fp), i + 256)), len(masks))

    return keys


# ------------------------------------------------------------------ the search


def near_fingerprints(fps: DataFrame, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """(``fp``, ``component``): what links of at most ``bits`` bits connect; ``fps`` are distinct and cheap to read again.

    Fingerprints linked with nothing may be left out.
    """
    if bits not in (2, 3):
        raise ValueError("links may differ in 2 or 3 bits")
    n = fps.count()
    m = min(bits + 1, max(2, int(64 / (math.log2(max(2, n)) + 2))))
    plan = Plan(partitions(_together(fps), n, m), bits)
    plan.count(fps, n)

    index, probes = stored(_spread(fps, _index_keys(plan))), stored(_spread(fps, _probe_keys(plan)))
    crowded = checkpoint(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("key"))
    some = not crowded.isEmpty()
    cool = lambda df: df.join(broadcast_if_small(crowded), "key", "left_anti") if some else df
    a, b = cool(probes).alias("a"), cool(index).alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= bits
    links = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") > F.col("b.fp")) & near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    if not some:
        return components(links).select(F.col("node").alias("fp"), "component")

    under = checkpoint(index.unionByName(probes).join(broadcast_if_small(crowded), "key", "left_semi").distinct())
    dense = checkpoint(under.select("fp").distinct())
    points = stored(_spread(dense, _points((0, 1))))
    holders = points.groupBy("key").agg(F.sort_array(F.collect_set("fp")).alias("held")).where(F.size("held") > 1)  # at most 65 are within a bit of a point
    steps = holders.select(F.get("held", F.lit(0)).alias("a"), F.explode(F.slice("held", 2, 64)).alias("b")).distinct()
    found = checkpoint(components(links.unionByName(steps)).select(F.col("node").alias("fp"), "component"))
    if bits < 3:
        return found

    # links of three bits between components
    own = dense.join(found, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))
    own = checkpoint(own)
    sizes = under.join(own, "fp").groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count(F.lit(1)).alias("several"))
    outside = under.join(own, "fp").join(largest.where("several > 1"), "key").where("component <> largest").select("fp").distinct()
    outside = checkpoint(outside)
    if outside.isEmpty():
        return found
    there = points.join(own, "fp").select("key", "component").distinct()
    here = _spread(outside, _points((2,))).join(own, "fp").select("key", F.col("component").alias("of"))
    more = here.join(there, "key").where("of <> component").select(F.col("of").alias("a"), F.col("component").alias("b")).distinct()
    joined = components(more).select(F.col("node").alias("component"), F.col("component").alias("to"))
    both = found.unionByName(own.join(found.select("fp"), "fp", "left_anti"))
    return both.join(joined, "component", "left").select("fp", F.coalesce("to", "component").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (hex), ``component_id`` (smallest id reachable) and ``kept``."""
    rows = stored(fingerprints(docs, id_col, text_col, words))
    fps = checkpoint(rows.groupBy("fp").agg(F.min("id").alias("first")))
    found = checkpoint(near_fingerprints(fps, bits, hot))
    ids = found.join(fps, "fp").groupBy("component").agg(F.min("first").alias("least"))
    named = found.join(ids, "component").select("fp", "least")
    named = fps.join(named, "fp", "left").select(F.col("fp").alias("of"), F.coalesce("least", "first").alias("component_id"))
    out = rows.join(named, F.col("fp") == F.col("of"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return out.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
