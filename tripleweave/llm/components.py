"""Connected components of a graph given as pairs, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.common import stored


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step over pairs ``(u, v)`` with u > v.

    Large: every node's greater neighbours are linked to its least neighbour (itself included). Small: every node's
    smaller neighbours, and the node, are linked to the least of them. A node's least neighbour is aggregated before it
    is joined back, so a node with very many neighbours is no single row or task.
    """
    sides = pairs.select(F.col("u").alias("n"), F.col("v").alias("m"))
    if large:
        sides = sides.unionByName(pairs.select(F.col("v").alias("n"), F.col("u").alias("m")))
    least = stored(sides.groupBy("n").agg(F.min("m").alias("least")).withColumn("least", F.least("n", "least")))
    linked = sides.join(least, "n")
    if large:
        out = linked.filter("m > n").select(F.col("m").alias("u"), F.col("least").alias("v"))
    else:
        out = linked.filter("m != least").select(F.col("m").alias("u"), F.col("least").alias("v")).unionByName(
            least.filter("n != least").select(F.col("n").alias("u"), F.col("least").alias("v"))
        )
    return out.filter("u > v").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the undirected ``pairs (a, b)`` of longs; component: its least node.

    Rounds of large and small stars until nothing changes, of the order of the logarithm of the nodes. Every round is
    a written table. Pairs may repeat and may name a node twice; nodes that only pair with themselves don't appear.
    """
    current = stored(
        pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    )
    mark = None
    while True:
        current = stored(_star(stored(_star(current, True)), False))
        # the pairs settle to (node, least); equal sums of equal numbers of pairs mean a settled table
        row = current.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if (row["n"], row["h"]) == mark:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        mark = (row["n"], row["h"])
