"""Accuracy, F1 and area under the curve of predictions, as aggregates.

The area is a sum of ranks: scores are added up by value, dealt out by ranges and
counted within them, and the ranges before are added from a table of one row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spread import written


def area_under_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """auc: the chance that a positive (label 1) has a higher score than a negative (0);
    equal scores count half.  Null without both, or without scores."""
    y = F.col(label).cast("int")
    values = df.where(y.isin(0, 1) & F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score"))
    values = values.agg(F.count("*").alias("n"), F.sum(y).alias("p"))
    ranges = values.repartitionByRange("score").withColumn("range", F.spark_partition_id())
    ranges = written(ranges, "scores")
    totals = ranges.groupBy("range").agg(F.sum("n").alias("rows"))  # one row a range
    before = totals.select("range", (F.sum("rows").over(Window.orderBy("range")) - F.col("rows")).alias("before"))
    lower = F.sum("n").over(Window.partitionBy("range").orderBy("score")) - F.col("n")
    rank = F.col("before") + F.col("lower") + (F.col("n") + 1) / 2
    sums = ranges.withColumn("lower", lower).join(F.broadcast(before), "range").agg(F.sum(F.col("p") * rank).alias("ranks"), F.sum("p").cast("double").alias("pos"), F.sum(F.col("n") - F.col("p")).cast("double").alias("neg"))
    area = F.try_divide(F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2, F.nullif(F.col("pos") * F.col("neg"), F.lit(0.0)))
    return sums.select(area.alias("auc"))


def classification_metrics(df: DataFrame, label: str, prediction: str = "prediction", score: str | None = None) -> DataFrame:
    """n, accuracy, f1 (of classes, weighted by their rows) and auc (null without
    ``score``): one pass for the counts of label and prediction, one for the ranks."""
    cells = df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    cells = cells.groupBy(F.col(label).cast("double").alias("y"), F.col(prediction).cast("double").alias("q")).agg(F.count("*").alias("n"))
    # Each cell counts for its class as one of three kinds; classes are few.
    kinds = F.explode(F.array(F.struct(F.col("y").alias("c"), F.col("n").alias("own"), F.lit(0).cast("long").alias("told"), F.when(F.col("y") == F.col("q"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("q").alias("c"), F.lit(0).cast("long").alias("own"), F.col("n").alias("told"), F.lit(0).cast("long").alias("hit"))))
    classes = cells.select(kinds.alias("k")).groupBy("k.c").agg(*[F.sum(f"k.{x}").alias(x) for x in ("own", "told", "hit")])
    f1 = F.coalesce(F.try_divide(2 * F.col("hit"), F.col("own") + F.col("told")), F.lit(0.0))
    n = F.sum("own")
    said = classes.agg(n.alias("n"), F.try_divide(F.sum("hit"), n).alias("accuracy"), F.try_divide(F.sum(f1 * F.col("own")), n).alias("f1"))
    return said.crossJoin(area_under_curve(df, label, score)) if score else said.withColumn("auc", F.lit(None).cast("double"))  # one row each


def hash_split(df: DataFrame, share: float, seed: int, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(first, rest): rows by a seeded hash of ``columns``, about ``share`` of them first;
    the same rows whatever the partitions, also when a lost one is worked out again."""
    first = F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1_000_000)) < int(share * 1_000_000)
    return df.where(first), df.where(~first)
