"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is one aggregate and one join per node, so a node with a third of all links is combined before the shuffle
and split by AQE; nothing is gathered on the driver but one answer per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Of links that point down; repeated ones are fine."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one link down, or only links up: then the smallest of each component holds all others."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down > 0 and up > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``(u, component)`` for every node of ``links(u, v)`` that is not the smallest of its component.

    Loops, repeated links and either direction are fine; an empty table gives an empty result.  The rounds run while
    the plan is built and grow with the logarithm of the longest chain; they end as soon as all components are stars.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = cut_lineage(_small_star(edges))
    while not _stars(edges):
        edges = cut_lineage(_small_star(_large_star(edges)))
    return edges.select("u", F.col("v").alias("component"))


def joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """``labels`` of ``components`` after ``more(u, v)`` links between the components named there, not their members."""
    top = cut_lineage(components(more))
    moved = labels.join(top.select(F.col("u").alias("component"), F.col("component").alias("to")), "component", "left")
    return moved.select("u", F.coalesce("to", "component").alias("component")).union(top)
