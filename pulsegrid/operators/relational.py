"""Joins, unions, dedupe and top-k that the jobs share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def attach_roster(sensor: DataFrame, roster: DataFrame) -> DataFrame:
    """Right join on customer: participants without data stay, unknown customers go.

    As an inner join and the roster's rest, so that Spark may broadcast the roster
    and the sensor rows never have to meet the participants without any.
    """
    with_data = sensor.join(roster, "customer")
    seen = sensor.select("customer").distinct()
    return with_data.unionByName(roster.join(seen, "customer", "left_anti"), allowMissingColumns=True)


def attach_roster_inner(df: DataFrame, roster: DataFrame) -> DataFrame:
    return df.join(roster, "customer")


def keep_customers(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("customer").distinct(), "customer", "left_semi")


def drop_customers(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("customer").distinct(), "customer", "left_anti")


def attach_static(blocks: DataFrame, clinical: DataFrame) -> DataFrame:
    """Left join on customer, one row per block."""
    return dedupe(blocks.join(clinical, "customer", "left"), ["customer", "unique_blocks"], clinical.columns)


def attach_weather(df: DataFrame, weather: DataFrame, ts: str = "sensor_block_end") -> DataFrame:
    return df.withColumn("date", F.to_date(ts)).join(weather, "date", "left")


def merge_counts(df: DataFrame, *counts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b, "customer", "left"), counts, df)


def week_pair_join(first: DataFrame, second: DataFrame, key: str = "customer", same_home: bool = False) -> DataFrame:
    """One row per customer of both weeks, columns suffixed; ``same_home`` keeps those
    whose home is the same in both."""
    named = lambda df, s: df.select(key, *[F.col(c).alias(c + s) for c in df.columns if c != key])
    pairs = named(first, "_first").join(named(second, "_second"), key)
    return pairs.where(F.col("home_first") == F.col("home_second")) if same_home else pairs


def attach_choice_sets(items: DataFrame, *choices: DataFrame) -> DataFrame:
    """Right joins on (customer, unique_day_id): only prompts with an answer stay."""
    return reduce(lambda a, b: a.join(b, ["customer", "unique_day_id"], "right"), choices, items)


def filter_status(df: DataFrame, statuses: list[str]) -> DataFrame:
    return df.where(F.col("status").isin(*statuses))


def filter_phase(df: DataFrame, studies: list[int]) -> DataFrame:
    return df.where(F.col("study").isin(*studies))


def clip_to_phase(df: DataFrame, end: str = "ema_base_end", slack_days: int = 1, ts: str = "startTimestamp") -> DataFrame:
    return df.where(F.col(ts) <= F.col(end).cast("timestamp") + F.expr(f"INTERVAL {int(slack_days)} DAY"))


def exclude_rows(df: DataFrame, rules: list[tuple[str, int, str]], ts: str = "quest_create") -> DataFrame:
    """Drops rows of (customer, study) from a time on."""
    hit = [(F.col("customer") == c) & (F.col("study") == s) & (F.col(ts) >= F.lit(t).cast("timestamp")) for c, s, t in rules]
    return df.where(~F.coalesce(reduce(lambda a, b: a | b, hit), F.lit(False))) if hit else df


def numeric_items(df: DataFrame, columns: list[str]) -> DataFrame:
    """Items as numbers; rows with any that is none are dropped."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns}).dropna("any", subset=columns)


def sort_by_time(df: DataFrame, ts: str = "startTimestamp", within: bool = True) -> DataFrame:
    """In time order within partitions; a global order shuffles everything and is
    seldom needed."""
    return df.sortWithinPartitions("customer", ts) if within else df.orderBy(ts)


def top_k_per_group(df: DataFrame, key: str, score: str, k: int = 3, tie: str | None = None) -> DataFrame:
    order = [F.col(score).desc(), *([F.col(tie)] if tie else [])]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def top_k_values(df: DataFrame, c: str, k: int) -> DataFrame:
    return df.groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).limit(k)


def dedupe(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def union_parts(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def incremental_append(old: DataFrame, new: DataFrame, ts: str = "startTimestamp") -> DataFrame:
    """``old`` and the rows of ``new`` later than all of it (one scalar comes back)."""
    mark = old.agg(F.max(ts)).first()[0]
    later = new if mark is None else new.where(F.col(ts) > F.lit(mark))
    return old.unionByName(later, allowMissingColumns=True)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def count_by(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(c).agg(F.count("*").alias("n"))


def n_customers(df: DataFrame, by: str | None = None, approximate: bool = False) -> DataFrame:
    n = (F.approx_count_distinct if approximate else F.countDistinct)("customer").alias("n_customers")
    return df.groupBy(by).agg(n) if by else df.agg(n)
