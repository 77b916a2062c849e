"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import removed, written


def _to_smallest(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with m, the smallest of u and its v.

    The smallest is pre-aggregated; joining on a struct has both sides shuffled for the join itself, so
    that Spark can split a node with very many links.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.struct("u").alias("at"), F.least("u", "m").alias("m"))
    return pairs.withColumn("at", F.struct("u")).join(least, "at").select("u", "v", "m")


def _signature(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (u, v): root is the least node of its component.

    Loops, repeated links and either direction are fine; no links give no rows. Each round is written to
    the shared folder, and rounds end when the links no longer change: then each node hangs on its root.
    """
    spark = links.sparkSession
    edges, path = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _to_smallest(large)
        edges, next_path = written(
            small.select("u", F.col("m").alias("v"))
            .unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        removed(spark, path)
        path = next_path
        after = _signature(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
