"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over undirected edges (a > b). Large: each node hands the smallest of its neighbours and itself to its larger
    neighbours; small: to its smaller ones and itself. The smallest is aggregated before it is joined, so a node may have any number of neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    rows = both.join(least, "a")
    out = rows.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else rows.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b): component is the smallest node that is reachable. No edges: no rows."""
    now = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        now = saved(_star(_star(now, True), False), "stars")
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == before:
            break
        before = tuple(sums)
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return saved(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), "components")


def with_component(rows: DataFrame, parts: DataFrame, node: str) -> DataFrame:
    """rows with the column component: their node's, or the node itself if it has no links."""
    found = joined(rows, parts.withColumnRenamed("node", node), [node], "left", 32)
    return found.withColumn("component", F.coalesce("component", node))
