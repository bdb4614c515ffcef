"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.session import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """node and component (the smallest node reachable) of every node of edges (a, b).

    Large stars hook each node's larger neighbours to its smallest one, small
    stars hook the smaller ones; both only group by node, and every step is a
    table in the shared folder. Rounds grow with the logarithm of the longest path.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = scratch.table(pairs, f"{name}-0")
    step = 0
    while True:
        step += 1
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.table(large, f"{name}-{step}-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = low.select("u", F.col("m").alias("v")).unionByName(hooked).distinct()
        small = scratch.table(small, f"{name}-{step}")
        scratch.drop(f"{name}-{step}-large")
        # a forest of stars: no node is both above and below another
        done = small.select(F.col("v").alias("u")).join(small.select("u"), "u", "left_semi").limit(1).count() == 0
        same = done and small.count() == small.select("u").distinct().count()
        scratch.drop(f"{name}-{step - 1}")
        current = small
        if same:
            roots = small.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return small.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
