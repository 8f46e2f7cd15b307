"""Connected components of links between nodes, by alternating star steps.

Each step replaces a node's links by links to the smallest node it sees: the
large-star step for its larger neighbours, the small-star step for the others
and itself. What stays is one star per component. Both steps are a grouping with
partial minima and a join on the node, so a node with a third of all links is a
skewed join that Spark divides, never a list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.llm.shared import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; root is its component's smallest node.

    `links` has columns a and b of one sortable type. Loops, repeated links and
    both directions are allowed; null ends are left out. Without links the
    result is empty.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .distinct())
    state = _state(edges)
    while state[0]:
        # Large star: larger neighbours of a node go to its smallest neighbour, or itself.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = (edges.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a")
                 .select(F.col("v").alias("a"), F.col("low").alias("b")))
        # Small star: a node and its smaller neighbours go to the smallest of them.
        large = cut(large)
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (large.join(low, "a").select(F.when(F.col("b") == F.col("low"), F.col("a"))
                                             .otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
                 .where("a <> b").distinct())
        edges = cut(small)
        before, state = state, _state(edges)
        if state == before:  # only stars stay as they are
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    """How many links there are, and a sum of 96 bits of hash that tells which."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")),
                           F.sum(F.hash("a", "b").cast("long"))).first())
