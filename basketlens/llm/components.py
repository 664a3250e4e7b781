"""Connected components of an undirected graph of 64-bit nodes.

Alternating star contraction: the large star links every neighbour above a
node to the node's smallest neighbour, the small star links the neighbours
below it.  Both keep components together, and the edges end up as one star
around each component's smallest node.  A round is two aggregations and two
joins; every round's edges are written as a table in the shared folder, so a
lost executor costs a re-read, and no links go to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions.lineage import table_checkpoint


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
        F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation.  The minimum per node is aggregated map-side; the
    join back splits a hot node (adaptive skew join)."""
    if large:
        near = _both_ways(edges)
        low = near.groupBy("u").agg(F.min("v").alias("m"))
        linked = near.join(low, "u").where(F.col("v") > F.col("u"))
        pairs = linked.select(F.col("v").alias("x"), F.least("u", "m").alias("m"))
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = near.groupBy("u").agg(F.min("v").alias("m"))
        linked = near.join(low, "u")
        pairs = linked.select(F.explode(F.array("u", "v")).alias("x"), "m")
    return (pairs.where(F.col("x") != F.col("m"))
            .select(F.col("x").alias("a"), F.col("m").alias("b")).distinct())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (columns ``a`` and ``b``,
    long) that is not its component's smallest node, the root.

    Self-links and repeated links are ignored; an empty input gives an empty
    result.  Raises when ``max_rounds`` rounds do not suffice (the number of
    rounds grows with the logarithm of a component's diameter).
    """
    edges = table_checkpoint(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    for _ in range(max_rounds):
        nxt = table_checkpoint(_star(_star(edges, large=True), large=False), "links")
        # The star form is a fixed point: the same count and checksum of edges
        # as before, and no node with two smaller neighbours.
        row = nxt.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        edges = nxt
        if state == (row["n"], row["s"]):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = (row["n"], row["s"])
    raise RuntimeError(f"components: not settled after {max_rounds} rounds")
