"""Connected components of an edge table, by large-star and small-star rounds on staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import drop, stage

#: A node has many edges from this number on, and from this part of all edges on, so that at most 2 * HOT_NODES nodes are broadcast.
HOT_EDGES, HOT_NODES = 1000, 4096


def _with_least(edges: DataFrame, least: DataFrame, many: int) -> DataFrame:
    """``edges`` with m, the least neighbour of u."""
    hot = least.where(F.col("n") >= many).select("u", F.col("m").alias("__m"))
    tagged = edges.join(F.broadcast(hot), "u", "left")
    done = tagged.where(F.col("__m").isNotNull()).select("u", "v", F.col("__m").alias("m"))
    rest = tagged.where(F.col("__m").isNull()).select("u", "v").join(least.where(F.col("n") < many).select("u", "m"), "u")
    return done.union(rest)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of an edge, comp being the least node of its component.

    Each round joins the neighbours of a node to the least of them (first the larger ones, then the
    rest), with a pre-aggregated minimum, so no neighbour list is held anywhere; the rounds needed grow with the logarithm of
    the longest path. Edges of a node with itself only name the node. Nodes with many edges get their minimum by a broadcast, as all their
    edges would meet in one task otherwise. What a round has read is deleted when the next one is written.
    """
    all_edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = all_edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now = stage(all_edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    n = now.count()
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        many = max(HOT_EDGES, n // HOT_NODES)
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _with_least(both.where("v > u"), least, many).select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _with_least(large, low, many).select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = stage(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        # Done when each node has one edge, to a node that has none itself.
        own = after.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        open_ = own.where("n > 1").select("u").union(after.join(own.select(F.col("u").alias("v")), "v", "left_semi").select("u"))
        done = open_.isEmpty()
        drop(now.sparkSession, now)
        if done:
            break
        now, n = after, after.count()
    return nodes.join(after.select(F.col("u").alias("node"), F.col("v").alias("comp")), "node", "left").select(
        "node", F.coalesce("comp", "node").alias("comp")
    )
