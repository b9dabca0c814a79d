"""Connected components by min-label hooking and pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkb.storage import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows those
    pointers to their ends by doubling, and contracts the edges; what is left
    has at most half the nodes that still have edges. Hubs are no trouble: the
    smallest neighbour is a partial aggregation, and contracted edges are
    distinct. Null ends and loops say nothing.
    """
    left = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    kind = left.schema["a"].dataType.simpleString()
    found = edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    first = True
    while left.take(1):
        both = left.select("a", "b").union(left.select("b", "a"))
        hooked = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("parent"))
        roots = follow(materialize(hooked, "hooked"))
        if first:
            found, first = roots.select("node", F.col("parent").alias("component")), False
        else:
            moved = found.join(roots.select(F.col("node").alias("component"), "parent"), "component", "left")
            found = materialize(moved.select("node", F.coalesce("parent", "component").alias("component")), "components")
        a = roots.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        b = roots.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        ends = left.join(a, "a").join(b, "b").where("pa <> pb")
        left = materialize(ends.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    return found


def follow(parents: DataFrame) -> DataFrame:
    """(node, parent) with every pointer followed to its end; each pass doubles the distance covered."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = parents.join(up, "parent", "left").select(
            "node", F.coalesce("grand", "parent").alias("parent"), F.coalesce(F.col("grand") != F.col("parent"), F.lit(False)).alias("moved")
        )
        parents = materialize(jumped, "jumped")
        if not parents.where("moved").take(1):
            return parents.select("node", "parent")
