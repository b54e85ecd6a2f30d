"""Connected components of a graph given as an edge table, by alternating star contraction.

Each round is two aggregations and joins on the edge table, written to the shared folder. Nodes with a large share of all edges are
joined by broadcast, which their share bounds. Neither edges nor labels come to the driver, which only sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hub_join, stage


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Edges (u, v) with v < u. Large: every larger neighbour is tied to the least of the closed neighbourhood; small: every smaller one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u"))
    tied = hub_join(both, least, "u", total)
    if large:
        out = tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: for each node with an edge, the least node that it reaches."""
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    edges = stage(edges, "edges")
    before = _state(edges)
    while before[0]:
        large = stage(_star(edges, True, 2 * before[0]), "edges")
        edges = stage(_star(large, False, before[0]), "edges")
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
