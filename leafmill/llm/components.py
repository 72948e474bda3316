"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is one group-by with map-side combining and one join of numbers. A node with many edges (the centre of a star of a third of all rows, say) never meets its edges in one task: nodes of more than DEGREE edges are told apart by the group-by, and their edges learn the least neighbour over a broadcast, or beyond its bound over salted keys. Edges go to the shared folder after each round, and those of the round before are deleted, so lineage and folder stay short and nothing but counts reaches the driver. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut, drop, meet

#: Edges of one node that a shuffled join brings to one task.
DEGREE = 64


def _told(edges: DataFrame, least: Column) -> tuple[DataFrame, DataFrame]:
    """(u, v, m: each edge with the least of its u; the table it rests on). Nodes of many edges number few: at most the edges over DEGREE."""
    found = cut(edges.groupBy("u").agg(least.alias("m"), F.count(F.lit(1)).alias("n")))
    hot = found.where(F.col("n") > DEGREE).select("u", "m")
    if hot.isEmpty():
        return edges.join(found.select("u", "m"), "u"), found
    rest = meet(edges, hot.select("u"), ["u"], "v", "left_anti").join(found.select("u", "m"), "u")
    return meet(edges, hot, ["u"], "v").select("u", "v", "m").unionByName(rest.select("u", "v", "m")), found


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) for each node with an edge, from edges with columns a and b; order is that of their type."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if before == now or not now[0]:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        told, first = _told(both, F.least(F.min("v"), F.col("u")))
        large = cut(told.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        told, second = _told(large, F.min("v"))
        down = told.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, cut(down.unionByName(told.select("u", F.col("m").alias("v"))).distinct())
        drop(old, first, large, second)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
