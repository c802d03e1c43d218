"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitframe.functions.cluster import attach, settle


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b) of one ordered type; root is the component's smallest node.

    Each round maps every node to the smallest of its neighbours and itself, twice over, and contracts the edges.
    A map's image stays connected and keeps the smallest node, so rounds end when no edge is left, after a
    number of rounds that grows with the logarithm of the nodes. Joins go through attach(), so a node
    with a large share of all edges is broadcast or salted. Null ends and loops are ignored.
    """
    live = settle(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct())
    maps = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = settle(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")))
        upper = near.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jump = settle(attach(near, upper, ["up"]).select("node", F.col("top").alias("up")))
        maps.append(jump)
        left = jump.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        right = jump.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        moved = attach(attach(live, left, ["a"]), right, ["b"])
        live = settle(moved.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"))
                      .filter(F.col("a") != F.col("b")).distinct())
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    total = maps[-1].select("node", F.col("up").alias("root"))
    for earlier in reversed(maps[:-1]):
        later = total.select(F.col("node").alias("up"), "root")
        # nodes that the later rounds no longer hold are roots already
        total = settle(attach(earlier, later, ["up"]).select("node", F.coalesce("root", "up").alias("root")))
    return total
