"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.columns import cut


def _least(links: DataFrame, self_too: bool) -> DataFrame:
    """Each node's least neighbour (itself included): a pre-aggregated group, so hubs cost one row a task."""
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    return low.select("u", F.least("u", "m").alias("m")) if self_too else low


def _stars(edges: DataFrame) -> bool:
    """Whether each node of edges (u > v, none twice) has one lesser neighbour or only greater ones."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("low")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("low")))
    ends = ends.groupBy("node").agg(F.sum("low").alias("lows"), F.min("low").alias("least"))
    return not ends.agg(F.max(F.expr("lows > 1 OR lows = 1 AND least = 0"))).first()[0]


def components(links: DataFrame) -> DataFrame:
    """links (u, v: any two longs a row) -> (node, component), component the least node that can be reached.

    Loops (u = v) and repeated links are harmless, rows with a null end are dropped, an empty table gives no rows.
    Each round writes its links to the checkpoint folder; links that are stars already take none. Hubs are joined, never gathered:
    Spark can split their rows.
    """
    edges = links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = cut(edges)
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both, True), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        low = _least(large, False)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
