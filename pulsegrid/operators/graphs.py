"""Connected components of an edge table, for nodes of any orderable type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spread import written


def connected(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """node, root: the smallest node that each node of ``edges`` (u, v) reaches.

    Each round hangs every node's larger neighbours on its smallest one, and then
    every node on the smallest of what it hangs on, until nothing moves; the rounds
    grow with the logarithm of a component's size.  Each round is a written table.
    """
    pairs = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = written(pairs, "edges"), None
    for _ in range(rounds):
        ends = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hub = ends.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("hub"))
        large = ends.where("v > u").join(hub, "u").select(F.col("v").alias("u"), F.col("hub").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("hub"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("hub").alias("v")).where("u != v")
        now = written(small.unionByName(least.select("u", F.col("hub").alias("v"))).distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        before = state
    raise RuntimeError(f"no end after {rounds} rounds")
