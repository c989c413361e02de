"""Connected components by alternating stars, in DataFrame operations."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

#: Edges that a task replaces by a forest at a time.
FOREST_EDGES = 500_000


class Forest:
    """Union-find over any keys; the root of a tree is its smallest key."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def tie(self, a, b) -> bool:
        """False if a and b were one tree already."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) to as few that tie the same nodes."""

    def out() -> pa.RecordBatch:
        rows = [(x, forest.root(x)) for x in forest.up]
        rows = [r for r in rows if r[0] != r[1]]
        return pa.record_batch([pa.array([u for u, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.int64())], ["u", "v"])

    forest, n = Forest(), 0
    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
            forest.tie(u, v)
        n += b.num_rows
        if n >= FOREST_EDGES:
            yield out()
            forest, n = Forest(), 0
    if n:
        yield out()


def _large(edges: DataFrame) -> DataFrame:
    """Edges (u > v): ties the larger neighbours of each node to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # cut: the join's exchange is then one that AQE can split at a node of very many edges
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    out = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
    drop(least)
    return out


def _small(edges: DataFrame) -> DataFrame:
    """Edges (u > v): ties each node and its smaller neighbours to the least of these."""
    least = cut(edges.groupBy("u").agg(F.min("v").alias("v")))
    rest = edges.join(least.select("u", F.col("v").alias("m")), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = cut(least.unionByName(rest).distinct())
    drop(least)
    return out


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that edges (a, b: long) touch; root is the smallest node it reaches.

    Each task first replaces its edges by a forest. Rounds grow with the logarithm of the longest
    chain; minima are combined map-side, so a node of very many edges costs no more than its
    edges. Edges with a null end, and loops, tie nothing.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u <> v")
    e = cut(e.mapInArrow(_forest, "u long, v long").distinct())
    now = _sum(e)
    while now[0]:
        large = _large(e)
        drop(e)
        e = _small(large)
        drop(large)
        before, now = now, _sum(e)
        # both are sets of pairs; in the end each node has its root alone
        if before == now:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
