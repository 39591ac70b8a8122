"""Situations and social settings of prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ema import PROMPT


def blau_index(df: DataFrame, c: str, keys: list[str] | None = None) -> DataFrame:
    """1 - sum of squared shares, over all rows or per group."""
    keys = keys or []
    counts = df.groupBy(*keys, c).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg((1 - F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("blau"))


def with_blau_index(df: DataFrame, c: str, keys: list[str]) -> DataFrame:
    return df.join(blau_index(df, c, keys), keys)


def situation_share(df: DataFrame, diagnosis: str, situation: str) -> DataFrame:
    """Percent of a diagnosis' prompts with each situation."""
    prompts = df.groupBy(diagnosis).agg(F.countDistinct(*PROMPT).alias("n_prompts"))
    counts = df.groupBy(diagnosis, situation).agg(F.count("*").alias("n"))
    return counts.join(prompts, diagnosis).withColumn("percent", F.col("n") / F.col("n_prompts") * 100)


def choice_combinations(df: DataFrame, c: str) -> DataFrame:
    """Sorted, comma-joined labels of each prompt, and how often each set occurs."""
    sets = df.groupBy(*PROMPT).agg(F.array_join(F.array_sort(F.collect_list(c)), ",").alias("combination"))
    return sets.groupBy("combination").agg(F.count("*").alias("n"))


def situation_means(df: DataFrame, situation: str, columns: list[str]) -> DataFrame:
    """Mean of sensor columns per situation, for prompts with one situation."""
    single = df.withColumn("_n", F.count("*").over(Window.partitionBy(*PROMPT))).where("_n = 1")
    return single.groupBy(situation).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def multi_hot(df: DataFrame, c: str, top: int = 9, rest: list[str] = ()) -> DataFrame:
    """0/1 columns of the ``top`` most frequent labels per prompt, and the first of
    ``rest``.  The labels are a result of that bounded size."""
    labels = [r[0] for r in df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).limit(top).collect()]
    flags = [F.max(F.when(F.col(c) == x, 1).otherwise(0)).alias(f"{c}_{x}") for x in labels]
    return df.groupBy(*PROMPT).agg(*flags, *[F.min(r).alias(r) for r in rest])


def trend_line(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Slope and intercept of y on x after de-duplication by the keys."""
    one = df.groupBy(*keys).agg(F.min(x).alias(x), F.min(y).alias(y))
    return one.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def zero_filled_histogram(df: DataFrame, c: str) -> DataFrame:
    """Rows per whole number from the least to the greatest, zeros included."""
    counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("long").alias("value")).agg(F.count("*").alias("n"))
    span = counts.agg(F.min("value").alias("low"), F.max("value").alias("high")).where("low is not null")
    return span.select(F.explode(F.sequence("low", "high")).alias("value")).join(counts, "value", "left").fillna(0, subset=["n"])
