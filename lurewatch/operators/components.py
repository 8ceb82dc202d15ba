"""Connected components by contraction.

Every round each node points to its smallest neighbour, pointers are followed to their ends by doubling, and
the edge list is rewritten to the survivors. Only nodes that were smallest among their neighbours survive,
so at most half of the connected nodes are left per round, and a long chain collapses in one. Rounds are
joins and a minimum per node, which combines map-side; no neighbour list is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.session import cut_lineage


def followed(pointers: DataFrame, steps: int = 64) -> DataFrame:
    """pointers(component, root) with every pointer followed to its end; the distance doubles per step, of which there are ``steps`` at most."""
    for _ in range(steps):
        ends = pointers.select(F.col("component").alias("root"), F.col("root").alias("end"))
        step = cut_lineage(pointers.join(ends, "root").select("component", F.col("end").alias("root"), (F.col("end") != F.col("root")).alias("moved")))
        pointers = step.select("component", "root")
        if step.where("moved").isEmpty():
            break
    return pointers


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, component); the component is its smallest node. Isolated nodes are not listed."""
    edges = cut_lineage(edges.select("a", "b").where("a <> b").distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b"))).distinct()
    mapping = cut_lineage(nodes.withColumn("component", F.col("node")))
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root"))
        smallest = followed(cut_lineage(smallest.select(F.col("a").alias("component"), "root")))
        mapping = cut_lineage(
            mapping.join(smallest, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        )
        left = edges.join(smallest, edges["a"] == smallest["component"]).select(F.col("root").alias("a"), "b")
        edges = cut_lineage(
            left.join(smallest, left["b"] == smallest["component"]).select("a", F.col("root").alias("b")).where("a <> b").distinct()
        )
    return mapping
