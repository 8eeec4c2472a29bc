"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.session import materialise


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of links (a, b): the smallest node of each component.

    Alternates between hooking larger neighbours and smaller neighbours of a node to its smallest
    one, until every node hangs on the smallest node of its component. The number of rounds grows
    with the logarithm of the number of nodes; every round is a table in the shared folder, and no
    list of neighbours is ever gathered. Nodes without links do not appear.
    """
    edges = materialise(
        edges.filter("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = _mark(edges)
    while True:
        both = _both_ways(edges)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = materialise(
            both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("a", "b", "m")
        edges = materialise(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(small.select("a", F.col("m").alias("b")))
            .filter("a != b").distinct()
        )
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return materialise(
        edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        .unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")))
        .distinct()
    )
