"""Connected components of a graph too large for one machine, by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import release, stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node on an edge; root: the smallest node of its component.

    Edges point from the larger to the smaller node.  In each round the smaller neighbours of a node are
    joined to the least of them, until every node has one; then paths are halved until all end at roots.
    The number of rounds grows with the logarithm of the longest path.  Loops count as nodes.
    """
    all_edges = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    links = first = all_edges.filter("u != v")
    while True:
        least = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = links.join(least, "u")
        moved = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links, before = stage(least.select("u", F.col("m").alias("v")).unionByName(moved).distinct(), "links"), links
        if before is not first:
            release(before)
        if links.count() == links.select("u").distinct().count():
            break
    parent, halved = links, links
    while True:
        up = parent.select(F.col("u").alias("v"), F.col("v").alias("w"))
        halved, before = stage(parent.join(up, "v", "left").select("u", F.coalesce("w", "v").alias("v"), F.col("w").isNotNull().alias("moved")), "parents"), halved
        release(before)
        parent = halved.select("u", "v")
        if halved.filter("moved").isEmpty():
            break
    roots = all_edges.select(F.col("v").alias("node")).unionByName(all_edges.select(F.col("u").alias("node"))).distinct()
    return roots.join(parent.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("root"))
