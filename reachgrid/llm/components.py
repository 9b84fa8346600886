"""Connected components of a table of pairs, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachgrid.session import checkpoint


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the least of them: larger neighbours (large star) or smaller ones and the node itself (small star)."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """node and component (its least node) for every node of ``pairs`` (u, v); pairs of a node with itself count for nothing.

    Each round is written out; the number of rounds grows with the logarithm of the longest path.
    """
    high, low = F.greatest("u", "v"), F.least("u", "v")
    now = checkpoint(pairs.where("u <> v").select(high.alias("u"), low.alias("v")).distinct())
    while True:
        # Small stars take pairs with the larger node in front; both stars keep that order.
        after = checkpoint(_star(_star(now, True), False))
        a, b = (x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (now, after))
        now = after
        if a == b:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
