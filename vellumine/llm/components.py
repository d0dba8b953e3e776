"""Connected components of a graph given by its edges, without gathering them anywhere.

Alternating large-star and small-star steps on the edge table, each written to the shared
folder; the number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, remove


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours of each node to the smallest node among it and them.

    large: only neighbours larger than the node are linked, from both directions of each edge;
    else only neighbours not larger than it, and the node itself.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = both.join(least, "a")
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select("b", "m").union(least.select(F.col("a").alias("b"), "m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, home: str) -> DataFrame:
    """(node, root) for each node that has an edge; root is the smallest node of its component.

    ``edges``: columns a and b of one orderable type.  Self-loops are ignored.
    """
    spark = edges.sparkSession
    now = materialise(edges.select("a", "b").where("a <> b").distinct(), f"{home}/edges-0")
    sign = None
    for step in range(1, 200):
        after = materialise(_stars(_stars(now, True), False), f"{home}/edges-{step}")
        seen = after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        remove(spark, f"{home}/edges-{step - 1}")
        now = after
        if tuple(seen) == sign:
            break
        sign = tuple(seen)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
