"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its word shingles.  Equal sets count once.  A set is
embedded as minwise values.  In each of several independent trees documents branch
by their minwise values, at a coordinate of the tree's own for each depth; a pair of
similarity s stays together with probability s at each branching.  Nodes of at most
``NODE_ROWS`` documents are leaves, whose pairs are compared exhaustively on sketches
of the minwise values; larger ones branch on, down to ``MOST_DEPTH``.  Nodes of one
document go.  The number of trees follows from the target recall at the threshold for
a pair that branches ``MOST_DEPTH`` times in all of them (``missed``), so it holds for
every pair; where coordinates don't suffice for that, it is an error.

A leaf passes on a spanning forest of the pairs whose sketches come near
the threshold, not the pairs themselves.  A large node that keeps over half of its
parent's documents, or is still large at the last depth, holds a family of near copies, which
further branching would not take apart; it passes on a star of all its documents, without
comparing them.  What is connected in
forests and stars is a group, which holds all links of its members.  Groups are then
confirmed on full sets: their members' shingles are brought together once, similarity is
computed exactly, and a spanning forest of the true links is emitted, whose
connected components are the result.  A group too large for one task (``BLOCK_ROWS`` sets
or ``BLOCK_SHINGLES`` of theirs) is dealt to blocks, each with the same ``PIVOTS`` of its sets.
Families hang together by their pivots, so few sets stay outside the largest component so
found; those are a query set that is compared with the whole group, block by block.

Defined results: a null or empty text, or one of white space, has an empty set
and is linked with nothing.  A text of fewer words than a shingle is one
shingle.  Null ids are left as they are, each a component without an id.
Repeated rows have equal sets and share a component; rows that repeat an id with
another text are told apart by their sets, and each has the component of its own.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpoint, stored, whole_groups
from .components import components
from .hashing import LOWER, buffers, hash_words, mix64, shingles, slices

#: Minwise values of a set, to branch by and, by their low bytes, to compare.
T = 128
NODE_ROWS = 1024
MOST_DEPTH = 3
RECALL = 0.9999999
#: Sets of a group that meet in one task, and shingles of theirs, about.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 21
#: Sets of a larger group that meet all its blocks.
PIVOTS = 24

_rng = np.random.default_rng(20240101)
_A = (_rng.integers(1, 2**31, T, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 2**32, T, dtype=np.uint64).astype(np.uint32)


def minwise(s: np.ndarray) -> np.ndarray:
    """The ``T`` minwise values of a set of 64-bit hashes, 32 bits each."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(T, np.uint32(0xFFFFFFFF))
    for i in range(0, len(x), 1024):
        part = x[i : i + 1024, None] ^ _B[None, :]
        part *= _A[None, :]
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(low, part.min(axis=0), out=low)
    return low


def missed(share: float, trees: int) -> float:
    """Probability that a pair of this similarity, branching ``MOST_DEPTH`` times, meets in no leaf; no two branchings share a coordinate."""
    return (1 - share**MOST_DEPTH) ** trees


def trees_for(threshold: float, recall: float = RECALL) -> int:
    """The least number of trees that reaches the recall."""
    most = T // MOST_DEPTH
    found = next((n for n in range(1, most + 1) if missed(threshold, n) <= 1 - recall), None)
    if found is None:
        raise ValueError(f"a recall of {recall} at similarity {threshold} needs more than {most} trees; ask for {1 - missed(threshold, most):.4g} at most")
    return found


def least_likeness(threshold: float) -> float:
    """Sketches that agree in a smaller share are not followed up: over 4.5 standard deviations below."""
    return threshold - 4.5 * math.sqrt(threshold * (1 - threshold) / T)


class Forest:
    """Union-find over 0 .. n-1; ``edges`` are the unions that joined two sets."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((i, j))


def _digest(shingles: bytes) -> bytes | None:
    return hashlib.blake2b(shingles, digest_size=16).digest() if shingles else None


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """id, number of shingles, digest of the set, and minwise values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                data, offs = buffers(batch.column("text"))
                hashes, begins = hash_words(LOWER[data], offs)
                sets = [shingles(hashes[i:j], words) for i, j in zip(begins[:-1], begins[1:])]
                low = [minwise(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in ("id", "k1", "k2")),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array([x.tobytes() if x is not None else None for x in low], pa.binary()),
                    ],
                    names=["id", "k1", "k2", "n", "digest", "low"],
                )

    return docs.mapInArrow(run, "id long, k1 long, k2 long, n long, digest binary, low binary")


def _branch(rows: DataFrame, depth: int, trees: int) -> DataFrame:
    """(``tree``, ``node``, ``was``, ``rep``): the children of the nodes ``at`` which ``rows`` are, with their parents' sizes; at depth 0 each document in each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            low = np.frombuffer(b"".join(batch.column("low").to_pylist()), np.uint32).reshape(-1, T)
            rep = batch.column("rep").to_numpy()
            if depth:
                at = batch.column("at")
                many = np.diff(at.offsets.to_numpy())
                low, rep = np.repeat(low, many, axis=0), np.repeat(rep, many)
                tree, node, was = (at.flatten().field(c).to_numpy() for c in ("tree", "node", "size"))
                tree, node = tree[:, None], node.view(np.uint64)[:, None]
            else:
                tree = np.broadcast_to(np.arange(trees), (len(rep), trees))
                node = mix64(tree.astype(np.uint64) + np.uint64(1))
                was = np.zeros(tree.size, np.int64)
            value = np.take_along_axis(low, tree * MOST_DEPTH + depth, axis=1).astype(np.uint64)
            child = mix64(mix64(node * np.uint64(0x9E3779B97F4A7C15) + np.uint64(depth)) + value)
            fields = [tree.astype(np.int32).ravel(), child.view(np.int64).ravel(), was, np.repeat(rep, child.shape[1])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in fields], names=["tree", "node", "was", "rep"])

    return rows.mapInArrow(run, "tree int, node long, was long, rep long")


def _leaves(reps: DataFrame, trees: int) -> tuple[DataFrame, list[DataFrame]]:
    """(``node``, ``rep``) of all leaves with two documents or more, and of the nodes that are families, if any."""
    rows = reps.select("rep", "low")
    done, families = [], []
    for depth in range(MOST_DEPTH):
        rows = _branch(rows, depth, trees)
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        rows = checkpoint(rows.join(sizes, "node"))
        done.append(rows.where(F.col("size") <= NODE_ROWS).select("node", "rep"))
        large = rows.where(F.col("size") > NODE_ROWS)
        if large.isEmpty():
            break
        family = (F.lit(depth) == MOST_DEPTH - 1) | ((F.col("was") > 0) & (2 * F.col("size") > F.col("was")))
        if depth:
            families.append(large.where(family).select("node", "rep"))
        # a document's nodes, one a tree at most, travel together
        rest = large.where(~family).groupBy("rep").agg(F.collect_list(F.struct("tree", "node", "size")).alias("at"))
        rows = reps.select("rep", "low").join(rest, "rep").select("rep", "at", "low")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, families


def _sketches(reps: DataFrame) -> DataFrame:
    """(``r``, ``n``, ``sketch``): the low bytes of the minwise values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = np.frombuffer(b"".join(batch.column("low").to_pylist()), np.uint32).reshape(-1, T).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n"), pa.array([x.tobytes() for x in low], pa.binary())], names=["r", "n", "sketch"])

    return reps.select("rep", "n", "low").mapInArrow(run, "r long, n long, sketch binary")


def _compare_sketches(threshold: float):
    """Of batches sorted by node: forests of the pairs whose sketches are near, as links."""
    least = math.ceil(least_likeness(threshold) * T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "node"):
            node = t.column("node").to_numpy()
            rep = t.column("rep").to_numpy()
            n = t.column("n").to_numpy()
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, T)
            tree = np.arange(len(rep))  # of a row: the first row it is connected to
            edges: list[tuple[int, int]] = []
            step = 1
            rows = np.arange(len(rep) - 1)
            while len(rows):
                rows = rows[rows + step < len(rep)]
                rows = rows[node[rows] == node[rows + step]]
                a, b = rows, rows + step
                fit = (tree[a] != tree[b]) & (np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b]))
                a, b = a[fit], b[fit]
                for i in range(0, len(a), 4096):
                    x, y = a[i : i + 4096], b[i : i + 4096]
                    near = np.count_nonzero(sketch[x] == sketch[y], axis=1) >= least
                    for p, q in zip(x[near].tolist(), y[near].tolist()):
                        u, v = tree[p], tree[q]
                        if u != v:
                            tree[tree == max(u, v)] = min(u, v)
                            edges.append((p, q))
                step += 1
            if edges:
                e = np.array(edges)
                yield pa.RecordBatch.from_arrays([pa.array(rep[e[:, 0]]), pa.array(rep[e[:, 1]])], names=["a", "b"])

    return run


def _confirm(percent: int):
    """Of batches sorted by node: forests of the pairs that are links by their full sets; rows that are not ``asked`` aren't compared with one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "node"):
            node, rep = t.column("node").to_numpy(), t.column("rep").to_numpy()
            asked = t.column("asked").to_numpy(zero_copy_only=False)
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("found")]
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            edges: list[tuple[int, int]] = []
            for i, j in zip(first.tolist(), [*first[1:].tolist(), len(node)]):
                edges += [(rep[i + p], rep[i + q]) for p, q in true_forest(sets[i:j], percent, asked[i:j])]
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def true_forest(sets: list[np.ndarray], percent: int, asked: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that connect what the links of ``sets`` connect; links have 100 |a & b| >= percent |a | b|.

    Each set is counted against all before it by way of an inverted index.  Sets that
    are not ``asked`` come first and are in the index only, so links between two of
    them aren't looked for.
    """
    forest = Forest(len(sets))
    n = np.array([len(s) for s in sets])
    if len(sets) == 2:
        common = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if 100 * common >= percent * (int(n.sum()) - common) and n.min() else []
    asked = np.ones(len(sets), bool) if asked is None else asked
    order = np.lexsort((n, asked))
    values, inverse = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    owner = np.repeat(np.arange(len(order)), n[order])
    by_value = np.argsort(inverse, kind="stable")  # within a value by owner
    posting = owner[by_value]
    begins = np.searchsorted(inverse[by_value], np.arange(len(values) + 1))
    at = np.concatenate([[0], np.cumsum(n[order])])
    size = n[order]
    for i in range(max(1, int((~asked).sum())), len(order)):
        mine = inverse[at[i] : at[i + 1]]
        lo, hi = begins[mine], begins[mine + 1]
        length = hi - lo
        if not length.sum():
            continue
        flat = np.repeat(lo - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        common = np.bincount(posting[flat], minlength=len(order))[:i]
        for j in np.flatnonzero((common > 0) & (100 * common >= percent * (size[:i] + size[i] - common))).tolist():
            forest.join(int(order[j]), int(order[i]))
    return forest.edges


def _key(id_col: str, text_col: str) -> list[Column]:
    """What tells a document: id and a 128-bit hash of its text (``id``, ``k1``, ``k2``)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(*_key(id_col, text_col), F.col(text_col).alias("text"))


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", words: int = 5, percent: int = 80, recall: float = RECALL) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept``."""
    found = _classes(_slim(docs, id_col, text_col), words, percent, recall)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def _classes(slim: DataFrame, words: int, percent: int, recall: float) -> DataFrame:
    """Rows of ``_slim`` with size and digest of their sets, their ``class``, its smallest id as ``component``, and ``kept``."""
    threshold = percent / 100
    sets = checkpoint(_sets(slim, words))
    known = sets.where(F.col("id").isNotNull() & F.col("digest").isNotNull())
    # equal sets count once, under the smallest id, or a hash where an id has several sets
    same = checkpoint(known.groupBy("digest").agg(F.min("id").alias("first")))
    shared = same.groupBy("first").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select(F.col("first").alias("f"))
    unique = shared.isEmpty()
    if unique:
        same = same.withColumn("rep", F.col("first"))
    else:
        same = same.join(broadcast_if_small(checkpoint(shared)), F.col("first") == F.col("f"), "left")
        same = checkpoint(same.select("digest", "first", F.when(F.col("f").isNull(), F.col("first")).otherwise(F.xxhash64("digest")).alias("rep")))
    named = same.withColumnsRenamed({"digest": "d"})
    reps = known.join(named, (F.col("digest") == F.col("d")) & (F.col("id") == F.col("first")))
    reps = checkpoint(reps.select("rep", "n", "low").dropDuplicates(["rep"]))

    leaves, families = _leaves(reps, trees_for(threshold, recall))
    leaves = leaves.join(_sketches(reps), F.col("rep") == F.col("r")).select("node", "rep", "n", "sketch")
    near = leaves.repartition("node").sortWithinPartitions("node").mapInArrow(_compare_sketches(threshold), "a long, b long")
    for family in families:
        centre = family.groupBy("node").agg(F.min("rep").alias("a"))
        near = near.unionByName(family.join(centre, "node").where("a <> rep").select("a", F.col("rep").alias("b")))
    groups = checkpoint(components(near).select(F.col("node").alias("rep"), F.col("component").alias("group")))

    wanted = checkpoint(groups.join(same, "rep").select("rep", "group", "digest", "first"))
    texts = slim.join(broadcast_if_small(wanted.select(F.col("first").alias("f"))), F.col("id") == F.col("f"), "left_semi")
    full = _full_sets(texts, words).join(wanted.select(F.col("digest").alias("d"), "rep", "group"), F.col("digest") == F.col("d"))
    full = stored(full.select("rep", "group", "found").dropDuplicates(["rep"]))

    def confirmed(dealt: DataFrame) -> DataFrame:
        dealt = dealt.join(full.select("rep", "found"), "rep").select("node", "rep", "asked", "found")
        return dealt.repartition("node").sortWithinPartitions("node").mapInArrow(_confirm(percent), "a long, b long")

    weights = F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum(F.octet_length("found") / 8) / BLOCK_SHINGLES)
    blocks = checkpoint(full.groupBy("group").agg(F.ceil(weights).cast("int").alias("blocks")))
    small = full.select("rep", "group").join(blocks.where("blocks = 1"), "group")
    links = confirmed(small.select(F.col("group").alias("node"), "rep", F.lit(True).alias("asked")))
    large = blocks.where("blocks > 1")
    if not large.isEmpty():
        large = checkpoint(full.select("rep", "group").join(broadcast_if_small(large), "group"))
        links = checkpoint(links.unionByName(_large_links(large, confirmed)))
    found = components(links).withColumnRenamed("node", "rep")

    # components go by their smallest id
    least = found.withColumn("least", F.col("component"))
    if not unique:
        ids = found.join(same.select("rep", "first"), "rep").groupBy("component").agg(F.min("first").alias("least"))
        least = found.join(ids, "component")
    own = same.select("digest", "rep", "first").join(least.select("rep", "component", "least"), "rep", "left")
    own = own.select(F.col("digest").alias("d"), F.coalesce("component", "rep").alias("class"), F.coalesce("least", "first").alias("least"))
    out = sets.select("id", "k1", "k2", "n", "digest").join(own, F.col("digest") == F.col("d"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("least", "id"))
    return out.select("id", "k1", "k2", "n", "digest", "class", component.alias("component"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _large_links(large: DataFrame, confirmed) -> DataFrame:
    """Links that connect what the links within large groups (``group``, ``rep``, ``blocks``) connect."""
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    own = lambda blocks: F.pmod(F.xxhash64("rep"), F.col(blocks)).cast("int")
    # blocks of the group, all with its pivots: the sets whose hashes are least
    rank = F.row_number().over(Window.partitionBy("group").orderBy(F.xxhash64("rep"), "rep"))
    pivots = large.withColumn("rank", rank).where(F.col("rank") <= PIVOTS)
    rows = large.select("group", "rep", own("blocks").alias("i")).unionByName(pivots.select("group", "rep", every.alias("i"))).distinct()
    first = checkpoint(confirmed(rows.select(F.xxhash64("group", "i").alias("node"), "rep", F.lit(True).alias("asked"))))
    joined = components(first).withColumnRenamed("node", "rep")
    parts = checkpoint(large.join(joined, "rep", "left").select("group", "rep", "blocks", F.coalesce("component", "rep").alias("part")))
    counts = parts.groupBy("group", "part").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy("group").agg(F.max_by("part", F.struct("n", "part")).alias("largest"), F.sum("n").alias("all"), F.max("n").alias("most"))
    largest = largest.where("most < all").withColumn("out", F.expr(f"cast(ceil((all - most) / {BLOCK_ROWS}) AS int)"))
    left = checkpoint(parts.join(largest, "group").select("group", "rep", "blocks", "out", (F.col("part") != F.col("largest")).alias("asked")))
    # every set outside is asked for in every block of the group
    asked = left.where("asked").select("group", "rep", "asked", own("out").alias("o"), every.alias("i"))
    them = left.where("NOT asked").select("group", "rep", "asked", F.explode(F.sequence(F.lit(0), F.col("out") - 1)).alias("o"), own("blocks").alias("i"))
    # and two blocks of them meet, too
    one, two = F.least("o", "i"), F.greatest("o", "i")
    among = left.where("asked").select("group", "rep", "asked", own("out").alias("o"), F.explode(F.sequence(F.lit(0), F.col("out") - 1)).alias("i"))
    among = among.select(F.xxhash64("group", F.lit(-1), one, two).alias("node"), "rep", "asked").where(one != two)
    dealt = asked.unionByName(them).select(F.xxhash64("group", "o", "i").alias("node"), "rep", "asked")
    return first.unionByName(confirmed(dealt.unionByName(among)))


def _full_sets(texts: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                data, offs = buffers(batch.column("text"))
                hashes, begins = hash_words(LOWER[data], offs)
                found = [shingles(hashes[i:j], words).tobytes() for i, j in zip(begins[:-1], begins[1:])]
                digest = [_digest(x) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(found, pa.binary())], names=["digest", "found"])

    return texts.mapInArrow(run, "digest binary, found binary")


def deduplicate(docs: DataFrame, id_col="doc_id", text_col="text", words: int = 5, percent: int = 80, recall: float = RECALL) -> DataFrame:
    """The documents that stay, one of each component, with all their columns.

    Null ids, and texts that are null, empty or without words, all stay.  Of a
    component the row with the smallest id stays, of several texts with that id the
    one with the smallest hash, and of rows that repeat id and text one.
    """
    key = ["id", "k1", "k2"]
    classes = _classes(_slim(docs, id_col, text_col), words, percent, recall).where("id IS NOT NULL AND digest IS NOT NULL")
    classes = checkpoint(classes.select(*key, "class", "kept"))
    lost, kept = classes.where("NOT kept").select(*key), classes.where("kept")
    several = checkpoint(kept.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("class"))
    # the caller's columns travel as one, so that no name clashes
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_key(id_col, text_col))
    same = lambda other: rows["id"].eqNullSafe(other["id"]) & (rows["k1"] == other["k1"]) & (rows["k2"] == other["k2"])
    if several.isEmpty():
        lost = lost.distinct()
        return rows.join(lost, same(lost), "left_anti").select("row.*")
    kept = kept.join(broadcast_if_small(several), "class")
    kept = kept.join(kept.groupBy("class").agg(F.min(F.struct("k1", "k2")).alias("pick")), "class").withColumn("picked", F.struct("k1", "k2") == F.col("pick"))
    kept = checkpoint(kept.select(*key, "picked"))
    lost = lost.unionByName(kept.where("NOT picked").select(*key)).distinct()
    again = kept.where("picked").groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key)
    gone = lost.unionByName(again)
    stay = rows.join(gone, same(gone), "left_anti")
    return stay.unionByName(rows.join(again, same(again), "left_semi").dropDuplicates(key)).select("row.*")
