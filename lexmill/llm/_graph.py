"""Connected components by label propagation with pointer jumping; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import discard, staged


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long, not null), in any direction, with repeats or not. Returns v, c: each vertex with the least one it reaches.

    A round takes the least label of all neighbours (aggregated before the shuffle, so a hub is no burden) and then the label
    of the label, so rounds grow with the logarithm of the longest path. An empty table gives an empty result.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("c")), "labels")
    before = labels
    while True:
        near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("c").alias("m"))
        nearer = labels.join(near, labels.v == near.a, "left").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jump = labels.select(F.col("v").alias("w"), F.col("c").alias("far"))
        new = staged(nearer.join(jump, nearer.c == jump.w, "left").select("v", "old", F.least("c", "far").alias("c")), "labels")
        done = new.filter("old <> c").isEmpty()
        discard(*([both] if done else []), before)
        before, labels = new, new.select("v", "c")
        if done:
            return labels
