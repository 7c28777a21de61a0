"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links the larger (large star) or the smaller (small star) neighbours of each node to its smallest one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    out = both.join(least, "a")
    if large:
        out = out.where("b > a").select(F.col("m").alias("a"), "b")
    else:
        out = out.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
    return out.where("a <> b").distinct()


def connected(edges: DataFrame, once: bool = False) -> DataFrame:
    """(node, label) of every node of the undirected ``edges`` (a, b): label is the component's smallest node.

    Steps go on until no link changes, which takes them a number that grows with
    the logarithm of the largest component. ``once``: the large star of a step is
    written before the small one reads it, which else works it out for each use;
    that pays where links are many beside the nodes.
    """
    edges = durable(edges.where("a <> b").distinct(), "edges")
    before = None
    while True:
        old, large = edges, _star(edges, True)
        large = durable(large, "large-star") if once else large
        edges = durable(_star(large, False), "edges")
        release(old, *([large] if once else []))
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("b").alias("node"), F.col("a").alias("label"))
    return nodes.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
