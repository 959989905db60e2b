"""Connected components of links that may be too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paperlens.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b: bigint, a <> b); root is the smallest node reachable.

    Rounds of two steps on the written set of links: every node links its larger neighbours to the smallest node it
    knows, then the smaller ones.  A hub keeps one link per neighbour throughout, and smallest nodes are aggregated
    map-side; chains shorten by a factor each round.  Each round is written to the shared folder.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # larger neighbours, and the node itself, go to the smallest
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(least, "a")
        small = joined.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = stored(small.distinct(), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        if state[0] == state[2] and state == before:
            break
        before = state
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
