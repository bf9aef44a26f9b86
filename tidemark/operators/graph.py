"""Closures over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def closure(edges: DataFrame, child: str, parent: str, rounds: int = 64) -> DataFrame:
    """(node, ancestor, depth) with the least depth.  Paths are doubled every round, so a
    chain of n edges takes log2(n) joins; cycles end with the last new pair."""
    found = edges.where(F.col(child) != F.col(parent)).select(F.col(child).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("depth")).distinct()
    known, n = -1, 0
    while n < rounds:
        step = found.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("higher"), F.col("depth").alias("more"))
        longer = found.join(step, "ancestor").select("node", F.col("higher").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        found = found.unionByName(longer).where("node <> ancestor").groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))
        found = cut(found)
        count = found.count()
        if count == known:
            break
        known, n = count, n + 1
    return found
