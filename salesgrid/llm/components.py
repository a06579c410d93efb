"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or not larger) neighbours to its smallest one, itself included."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.filter("u <> m").select("u", F.col("m").alias("v"))).distinct()


def _is_forest(edges: DataFrame) -> bool:
    """Whether every node either links to one smaller node or is only linked to."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    degrees = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return degrees.agg(F.count(F.when((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0)), 1))) \
        .first()[0] == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (u, v): the smallest node reachable.

    Each round writes its edges to the shared folder, so that lineage stays
    short and lost executors cost one round. A hub's edges are aggregated
    partially before each shuffle, and the join back is one that AQE can split.
    The number of rounds grows with the logarithm of the longest path. Loops
    and null ends are left out; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    clean = edges.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    table, path = scratch.write(
        clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _is_forest(table):
        wide, middle = scratch.write(_star(table, large=True), "edges")
        table, fresh = scratch.write(_star(wide, large=False), "edges")
        scratch.remove(spark, path, middle)
        path = fresh
    pairs = table.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(pairs.select(F.col("component").alias("node"), "component").distinct())
