"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.llm.scratch import discard, stored


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least of u and all its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """From links (a, b) of identifiers: node and component, the least node of its component; links need not be distinct.

    Each round writes the links that are left; it ends when a round changes
    none. Nodes without a link are not in the result.
    """
    edges, path = stored(spark, links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, large_path = stored(spark, large.where("u <> v").distinct(), "large-stars")
        met = _with_least(large)
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v")))
        edges, next_path = stored(spark, small.where("u <> v").distinct(), "small-stars")
        discard(spark, path, large_path)
        path = next_path
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
