"""Connected components of an edge table that no single machine has to hold.

Union-find inside each partition turns its edges into a forest; rounds of large-star and small-star then join
the forests until every node points at the smallest id of its component.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.kit import Tables, arrow

EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Edges that one union-find takes before it gives its forest out; bounds a task's memory.
AT_ONCE = 1_000_000
#: Rows of a node from which it may be a hub, and how many hubs there may be (two longs each).
HUB_ROWS, HUBS = 1_000, 100_000


class UnionFind:
    """Smallest member as root, path halving."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        low, high = (x, y) if x < y else (y, x)
        self.up[high] = low
        return True

    def stars(self) -> tuple[list, list]:
        """(roots, nodes) of each node that isn't a root."""
        nodes = [x for x in self.up if self.up[x] != x]
        return [self.root(x) for x in nodes], nodes


def _forest(batches):
    found, seen = UnionFind(), 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found.join(a, b)
        seen += batch.num_rows
        if seen >= AT_ONCE:
            a, b = found.stars()
            yield arrow({"a": a, "b": b}, EDGES)
            found, seen = UnionFind(), 0
    a, b = found.stars()
    yield arrow({"a": a, "b": b}, EDGES)


def _joined(rows: DataFrame, least: DataFrame, key: str, edges: int) -> DataFrame:
    """rows with the m of their key in least (key, m, n): keys of many rows by broadcast, others by shuffle.

    rows has at most 2 * edges rows, of which a hub has more than its limit, so there are HUBS hubs at most.
    """
    limit = max(HUB_ROWS, 2 * edges // HUBS)
    hubs = F.broadcast(least.where(F.col("n") > limit).select(key, "m"))
    plain = rows.join(hubs.select(key), key, "left_anti").join(least.where(F.col("n") <= limit).select(key, "m"), key)
    return plain.select("a", "b", "m").union(rows.join(hubs, key).select("a", "b", "m"))


def components(edges: DataFrame, tables: Tables, name: str) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest id that can be reached.

    Loops and repeated edges do no harm; edges with a null end are left out; no edges give no rows.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    forest = edges.mapInArrow(_forest, "a long, b long").repartition("b").mapInArrow(_forest, "a long, b long")
    now, turn = tables.keep(forest, f"{name}-0"), 0
    mark = _mark(now)
    while mark[0]:
        # large-star: every larger neighbour moves to the smallest neighbour
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = _joined(both, least, "a", mark[0]).where("b > a").select(F.col("m").alias("a"), "b").where("a <> b")
        # a node with many smaller neighbours has one edge from each partition after this
        large = large.mapInArrow(_forest, "a long, b long")
        # small-star: every node and its smaller neighbours move to the smallest of these
        least = large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
        small = _joined(large, least, "b", mark[0]).select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b")
        turn += 1
        after = tables.keep(small.distinct(), f"{name}-{turn}")
        tables.drop(f"{name}-{turn - 1}")
        now, last, mark = after, mark, _mark(after)
        if mark == last:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a"), F.col("a")).distinct())


def _mark(edges: DataFrame) -> tuple[int, ...]:
    """The number of edges and two sums of independent hashes: unequal for different edge sets but by a chance of 1e-12."""
    total = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), "a", "b") % 1_000_003), F.lit(0))
    return tuple(edges.agg(F.count("*"), total(1), total(2)).first())
