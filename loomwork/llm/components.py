"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import common


def _step(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """edges: (u, v), `total` of them. Hang every larger (large) or every not larger (small) neighbour of u, and in a small step u itself, on the least of u and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.filter("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")).withColumn("m", F.least("u", "m"))
    hung = common.join_counted(near, least, ["u"], "degree", (2 if large else 1) * total, "inner")
    out = hung.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether no node hangs on two others, or on one and has others hung on it."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node with a link, component being its smallest node. Self-links are ignored.

    Rounds go on until the edges form stars; each is written to the shared folder, and the one before deleted. Edges never come to
    the driver, and a node with a 64th of all links or more is joined by broadcast of its one row.
    """
    edges = common.table(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    while not _stars(edges):
        grown = common.table(_step(edges, True, edges.count()), "edges")
        shrunk = common.table(_step(grown, False, grown.count()), "edges")
        common.discard(edges, grown)
        edges = shrunk
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
