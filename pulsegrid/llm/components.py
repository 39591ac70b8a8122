"""Connected components of an edge table by alternating stars.

Large-star and small-star steps (Kiveris et al., 2014) on DataFrames: each round
is two aggregations with map-side combine and two joins that can be split, so a
node with a great many edges never has to meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them.  ``u`` > ``v``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node``, ``root`` (its smallest reachable node) for the nodes of ``edges``
    (columns u, v; long; both directions or one; loops are ignored)."""
    spark = edges.sparkSession
    path = common.scratch(spark, "edges")
    edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().write.parquet(path)
    current, said = spark.read.schema("u long, v long").parquet(path), None
    for _ in range(rounds):
        before, path = path, common.scratch(spark, "edges")
        _small_star(_large_star(current)).write.parquet(path)
        common.forget(spark, before)
        current = spark.read.schema("u long, v long").parquet(path)
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_if(F.col("u") <= F.col("v"))).first()
        if now == said:
            break
        said = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
