"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.llm import common


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the smallest node that is reachable.

    Null ends and loops are ignored, repeated links count once, an empty table gives no rows. Every round is a
    few aggregations with map-side combining; the links are staged between rounds and never leave the executors.
    """
    edges = common.staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(most_rounds):
        # large star: every larger neighbour of a node moves to the node's smallest neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: the smaller neighbours of a node, and the node, move to the smallest
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = common.staged(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        before = state
    raise RuntimeError("components did not settle")
