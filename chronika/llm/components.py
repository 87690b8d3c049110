"""Connected components of a graph given by its edges, as joins of edge tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronika.llm.common import checkpointed


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of edges (a, b): the smallest node that it is linked with.

    Large-star and small-star steps in turn (Kiveris et al., 2014): each round every node points
    its larger neighbours, then its smaller ones, to the smallest node around it. Minima are
    taken by aggregates with partial sums on the map side, so that a hub costs one row a task; the
    join back is one that Spark splits if a hub is skewed. The edges are checkpointed after each
    round. No edges give no rows; loops and repeated edges do no harm; null ends are dropped.
    """
    rows = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and a != b").distinct())
    for _ in range(max_rounds):
        both = rows.union(rows.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        after = small.select("b", "m").filter("b != m").toDF("a", "b").union(low.toDF("a", "b")).distinct()
        after = checkpointed(after)
        # Stars: every node points to one smaller node that points nowhere itself.
        settled = after.agg(F.count("*") == F.count_distinct("a")).first()[0] and after.join(after.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
        rows = after
        if settled:
            break
    else:
        raise RuntimeError("components did not settle")
    return rows.select(F.col("a").alias("node"), F.col("b").alias("component")).union(rows.select("b", "b").distinct())


class Union:
    """Sets of 0..n-1 inside one task; pairs come as arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the sets of each pair; the smallest member is the root."""
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up
