"""Groups of linked rows: union-find inside a task, stars across tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import join_per_key
from tillscope.sources import written_table


class Forest:
    """Union-find over 0..n-1 in numpy; the root of a group is its smallest member."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        """Roots of members, with the paths to them shortened."""
        root = self.parent[at]
        while True:
            above = self.parent[root]
            if np.array_equal(above, root):
                break
            root = above
        self.parent[at] = root
        return root

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the groups of a[i] and b[i], for all i at once."""
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of the edges: ``node``, ``component``.

    ``edges`` has long columns ``a`` and ``b``, in any direction, repeats and loops allowed; NULL
    ends are dropped. Large-star and small-star steps alternate: the first hangs every larger
    neighbour of a node on the node's smallest neighbour, the second does so with the smaller ones.
    Each step is a smallest-neighbour aggregation (with map-side combine, so a hub is one row per
    task) and a join back on the node (``join_per_key``), in which the edges of a hub are not
    shuffled: every component ends as a star, so a giant one is a hub in each step. The edges of a
    step are written, so a lost executor repeats one step at most; the number of steps grows with
    the logarithm of the longest chain. No edges give no rows.
    """
    a, b = F.col("a"), F.col("b")
    apart = edges.where("a is not null and b is not null and a <> b")
    now = written_table(
        apart.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links"
    )
    seen = _mark(now)
    while True:
        # Large star: seen from each node, the larger neighbours go to the smallest of all.
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.least(a, F.min("b")).alias("low"))
        large = join_per_key(both.where("b > a"), low, ["a"], "merge").select(b.alias("a"), F.col("low").alias("b"))
        step = written_table(large.distinct(), "large-star")
        # Small star: of the smaller neighbours that each node then has, all go to the smallest.
        low = step.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("low"))
        ends = F.array(
            F.struct(a.alias("a"), F.col("low").alias("b")), F.struct(b.alias("a"), F.col("low").alias("b"))
        )
        small = join_per_key(step, low, ["a"], "merge").select(F.explode(ends).alias("e")).select("e.*")
        now = written_table(small.where("a <> b").distinct(), "small-star")
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    # Now each node but the smallest of its group has one edge, to that smallest.
    return now.select(a.alias("node"), b.alias("component")).unionByName(
        now.select(b.alias("node"), b.alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    """Number and summed hash of the edges: equal tables have equal marks."""
    total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), total).first())
