"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribado.session import materialize


def _hang(edges: DataFrame, onto_larger: bool) -> DataFrame:
    """One star step over directed `(a, b)` rows that are all there in both directions.

    The larger neighbours of a node (with `onto_larger`), or the node and its smaller neighbours, are hung onto the
    least of them all. The least is aggregated first and joined back, so a node with very many
    neighbours is a hot join key that adaptive execution splits, never one group.
    """
    if onto_larger:
        least = edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        moved = edges.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.filter("b < a")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.union(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def connected(edges: DataFrame) -> DataFrame:
    """`(node, component)` for all nodes of `edges` (a, b): the least node that can be reached.

    Alternates large and small stars until nothing changes; only a count and a checksum reach the driver.
    Every step is written to the shared folder. Loops and repeated edges do no harm.
    """
    edges = materialize(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    checksum = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40)))
    state = edges.select(checksum).first()[0]
    while True:
        edges = materialize(_hang(_both(_hang(_both(edges), True)), False))
        new = edges.select(checksum).first()[0]
        if new == state:
            break
        state = new
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
