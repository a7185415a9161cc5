"""Connected components of an edge table, without ever holding a component or all links in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: the root is the smallest node that is reachable.  ``edges`` has columns ``a`` and ``b``; nulls aren't linked.

    Each round maps a node to the first of itself and its neighbours and contracts the edges, in order of the nodes
    at first (a star around its smallest node is done at once), then in an order that a hash draws anew each round,
    with which the number of nodes of a long chain falls by a constant factor.
    """
    edges = stored(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "edges")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("at", F.col("node"))
    turn = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))

        def order(c: str):
            return F.struct(F.lit(0).cast("long") if turn < 2 else F.xxhash64(F.col(c), F.lit(turn)), F.col(c).alias("v"))

        first = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        to = stored(first.select(F.col("a").alias("n"), F.least(F.col("m"), order("a"))["v"].alias("to")).where("n <> to"), "contraction")
        nodes = stored(nodes.join(to, nodes["at"] == to["n"], "left").select("node", F.coalesce("to", "at").alias("at")), "nodes")
        a, b = to.select(F.col("n").alias("a"), F.col("to").alias("a2")), to.select(F.col("n").alias("b"), F.col("to").alias("b2"))
        moved = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b"))
        edges = stored(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        turn += 1
    roots = nodes.groupBy("at").agg(F.min("node").alias("root"))
    return nodes.join(roots, "at").select("node", "root")
