"""Connected components of an edge table with distributed star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize


def _symmetric(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def connected_components(edges: DataFrame, node: str = "node") -> DataFrame:
    """(node, component) for each node of ``edges(a, b)``; component is the smallest node. Materialized.

    Alternates large-star and small-star steps until the edges are stars. Each
    step is an aggregate with map-side minima and an equi-join that AQE can
    split; no neighbour list is ever gathered. Empty edges give an empty table.
    """
    current = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    while True:
        # large star: every larger neighbour of u moves to the least node around u
        both = _symmetric(current)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every smaller neighbour of u, and u, moves to the least of them
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        floor = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(floor, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(floor.select(F.col("u").alias("a"), F.col("m").alias("b")))
        after = materialize(small.where("a <> b").distinct(), "edges")
        # stars: no centre is itself a leaf, and every leaf has one centre
        ends = after.groupBy("a").agg(F.count("*").alias("centres")).unionByName(after.select(F.col("b").alias("a"), F.lit(0).cast("bigint").alias("centres")).distinct())
        knots = ends.groupBy("a").agg(F.count("*").alias("roles"), F.max("centres").alias("centres")).where("roles > 1 or centres > 1")
        discard(current)
        if knots.isEmpty():
            leaves = after.select(F.col("a").alias(node), F.col("b").alias("component"))
            out = materialize(leaves.union(after.select(F.col("b").alias(node), F.col("b").alias("component")).distinct()), "components")
            discard(after)
            return out
        current = after
