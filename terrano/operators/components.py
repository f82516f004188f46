"""Connected components by alternating stars: few rounds also on long chains, nothing gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terrano.session import join_hot, written


def _star(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) with m, the smallest of u and its neighbours; hubs are joined by broadcast."""
    lowest = written(edges.groupBy("u").agg(F.min("v").alias("_v"), F.count(F.lit(1)).alias("c")), "lowest")
    return join_hot(edges, lowest.select("u", F.least("u", "_v").alias("m")), "u", lowest.select("u", "c"))


def components(edges: DataFrame) -> DataFrame:
    """id, component: the smallest id that each node of ``edges`` (a, b: whole numbers) is linked with.

    Rounds link every node's larger neighbours to its smallest, then its smaller ones; paths halve, so their number grows
    with the logarithm of the longest. Each round is written. Nodes without a link to another are not returned.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    told = None
    while True:
        both = written(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = written(large, "large")
        small = _star(down)
        now = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == told:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
        told = seen
