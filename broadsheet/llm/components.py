"""Connected components of a link table by alternating large and small stars.

Links are first thinned: each batch of them, wherever it lies, becomes a spanning
forest of itself.  Then every step is a join and an aggregate over links, with a
checkpoint after each round; nothing is collected but the count by which a round
tells that it changed nothing.  A third of all nodes may hang on one: its links are
pre-aggregated for the minimum, and the joins are left to AQE's skew handling.
Few links (at most ``few``, counted first) are joined by one task instead, as rounds
of joins over so little would be nothing but overhead; the result is the same.
Links are written before they are thinned, so no task runs two Python workers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


class Forest:
    """Union-find over numbers; the root of a tree is its least."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, i: int) -> int:
        up = self.up
        while (above := up.setdefault(i, i)) != i:
            up[i] = i = up[above]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)

    def stars(self) -> pa.RecordBatch:
        """(``u``, ``v``): each node but roots with its root."""
        rows = [(i, self.root(i)) for i in list(self.up)]
        rows = [r for r in rows if r[0] != r[1]]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["u", "v"])


def _thinned(links: DataFrame, whole: bool) -> DataFrame:
    """A spanning forest, as stars, of each batch of links, or of all of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                forest.join(u, v)
            if not whole:
                yield forest.stars()
                forest = Forest()
        if whole:
            yield forest.stars()

    return links.mapInArrow(run, "u long, v long")


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, few: int = 100_000) -> DataFrame:
    """(``node``, ``component``): each linked node with the smallest node it can reach; nodes are longs."""
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    pairs = checkpoint(pairs)
    if pairs.count() <= few:
        pairs = checkpoint(_thinned(pairs.coalesce(1), whole=True))
    else:
        pairs = _by_stars(_thinned(pairs, whole=False), most_rounds)
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())


def _by_stars(pairs: DataFrame, most_rounds: int) -> DataFrame:
    """Links (``u``, ``v``), u above v, until each node has its root alone."""
    pairs = checkpoint(pairs.distinct())
    seen = None
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        # large star: larger neighbours of a node go to the smallest of them all
        large = both.where("v > u").join(low, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours, and the node itself, go to the smallest
        small = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
        joined = large.join(small, F.col("u") == F.col("x"))
        pairs = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        # v = m also stands for (u, m) itself; other v leave u to the row where v = m
        pairs = checkpoint(pairs.where("u <> v").distinct())
        now = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_003), F.lit(0))).first()
        if now == seen:
            return pairs
        seen = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
