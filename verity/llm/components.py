"""Connected components of a table of links, by star contraction.

Each step points every neighbour of a node at the least node it knows of; long
chains halve with every pair of steps. A step costs one aggregation and one join
over the links, of which there are never more than at the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verity.llm.shared import written


def _contract(links: DataFrame, larger: bool) -> DataFrame:
    """``links`` hold (a, b) with a > b. For every node, neighbours on the asked
    side are joined to the least of its neighbours and itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if larger else links
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    pointed = near.join(least, "a")
    moved = pointed.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if larger else \
        pointed.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (the least node of its component) for every node of the
    links (a, b)."""
    current = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        # Larger neighbours first, then smaller ones; done when nothing moves.
        current = written(_contract(_contract(current, True), False), "links")
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = now
