"""Connected components of an undirected graph, by the smallest id, without collecting it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow, remove, written


class UnionFind:
    """Union by smallest label over arbitrary ids."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (nxt := up.get(root, root)) != root:
            root = nxt
        while (nxt := up.get(x, x)) != root:
            up[x] = root
            x = nxt
        return root

    def union(self, x: int, y: int) -> bool:
        a, b = self.find(x), self.find(y)
        if a == b:
            return False
        lo, hi = (a, b) if a < b else (b, a)
        self.up[hi] = lo
        self.up.setdefault(lo, lo)
        return True


def _forest(batches):
    """Each partition's edges as stars around the smallest id of each local component; flushed when
    the local graph reaches a bound, so memory doesn't grow with the partition."""
    found = UnionFind()

    def stars():
        nodes = list(found.up)
        roots = [found.find(x) for x in nodes]
        u, v = np.array(nodes, np.int64), np.array(roots, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], ["u", "v"])

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found.union(x, y)
        if len(found.up) > 1_000_000:
            yield stars()
            found = UnionFind()
    yield stars()


def _is_forest(edges: DataFrame) -> bool:
    """Whether the edges are stars around the least of each: no node has two roots, or one and is one."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("root"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("root")))
    wrong = ends.groupBy("x").agg(F.sum("below").alias("n"), F.max("root").alias("root")).where("n > 1 or n = 1 and root = 1")
    return edges.where("u < v").isEmpty() and wrong.isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) long pairs -> (node, root): every node of an edge, with the smallest id reachable.

    Per-partition union-find first shortens the edge list; then large-star and small-star rounds
    (Kiveris et al. 2014) until nothing changes. Nodes without edges and self-loops don't appear.
    """
    stars = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").transform(map_arrow, _forest, "u long, v long")
    e, path = written(stars.distinct(), "edges")
    for _ in range(max_rounds):
        if _is_forest(e):
            break
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: larger neighbours of u go to the least of u's neighbourhood.
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(low, "u").select(F.explode(pairs).alias("e")).select("e.*").where("u <> v").distinct()
        before = path
        e, path = written(small, "edges")
        remove(e.sparkSession, [before])
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
