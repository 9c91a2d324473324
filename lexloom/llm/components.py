"""Connected components by contraction of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that edges (a, b) reach from each node that has an edge.

    Each round every node points at its smallest neighbour (or itself) and edges are rewritten between what the nodes
    point at, until none is left; an edge from each target to its own target keeps chains together.
    """
    left = checkpointed(edges.where("a <> b").select("a", "b").distinct())
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    at = nodes.select("node", F.col("node").alias("component"))
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select("b", "a"))
        to = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to")).select(F.col("a").alias("from"), "to"))
        moved = (
            left.join(to, left.a == to["from"]).select(F.col("to").alias("a"), "b")
            .join(to, F.col("b") == to["from"]).select("a", F.col("to").alias("b"))
        )
        chain = to.select(F.col("to").alias("a")).distinct().join(to, F.col("a") == to["from"]).select("a", F.col("to").alias("b"))
        left = checkpointed(moved.union(chain).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        at = checkpointed(at.join(to, at.component == to["from"], "left").select("node", F.coalesce("to", "component").alias("component")))
    return at
