"""Sensor availability and coverage."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import FINISHED, SHORT_VERSIONS

#: Value column of each sensor type.  Fixed values: the study's types that are not long.
DOUBLE_TYPES = ("Latitude", "Longitude", "Steps", "ActiveBurnedCalories", "CoveredDistance", "FloorsClimbed")
STRING_TYPES = ("Timezone",)
BOOLEAN_TYPES = ("SleepBinary", "WalkBinary", "RunBinary", "BikeBinary", "RestBinary")


def type_value(type_: str = "type") -> Column:
    """Whether a record's own value column, by its type, holds a value."""
    t = F.col(type_)
    return (
        F.when(t.isin(*DOUBLE_TYPES), F.col("doubleValue").isNotNull())
        .when(t.isin(*STRING_TYPES), F.col("stringValue").isNotNull())
        .when(t.isin(*BOOLEAN_TYPES), F.col("booleanValue").isNotNull())
        .otherwise(F.col("longValue").isNotNull())
    )


def hourly_presence(sensor: DataFrame) -> DataFrame:
    """Any value per customer, type, day and hour (map-side combined)."""
    keys = ["customer", "type", F.to_date("startTimestamp").alias("day"), F.hour("startTimestamp").alias("hour")]
    return sensor.groupBy(*keys).agg(F.max(type_value()).alias("available"))


def daily_availability(hourly: DataFrame) -> DataFrame:
    n = F.sum(F.col("available").cast("int"))
    return hourly.groupBy("customer", "type", "day").agg(F.max(F.col("available").cast("int")).alias("available_binary"), n.alias("available_hours"))


def densify_days(daily: DataFrame, bounds: DataFrame) -> DataFrame:
    """Every day from the phase start to the last seen, for each type seen, with zeros;
    customers without a bound stay as they are.  ``bounds``: customer, base_start."""
    values = ["available_binary", "available_hours"]
    seen = daily.groupBy("customer").agg(F.max("day").alias("last"))
    spans = seen.join(bounds.where("base_start is not null"), "customer").where("base_start <= last")
    types = daily.select("customer", "type").distinct()
    grid = types.join(spans.select("customer", F.explode(F.sequence("base_start", "last")).alias("day")), "customer")
    filled = grid.join(daily, ["customer", "type", "day"], "left").fillna(0, subset=values)
    rest = daily.join(bounds.where("base_start is not null").select("customer"), "customer", "left_anti")
    return filled.select("customer", "type", "day", *values).unionByName(rest.select("customer", "type", "day", *values))


def with_relative_day(daily: DataFrame, bounds: DataFrame) -> DataFrame:
    return daily.join(bounds, "customer", "left").withColumn("relative_day", F.date_diff("day", "base_start") + 1)


def calculate_data_coverage(sensor: DataFrame, roster: DataFrame, today: datetime.date, groups: dict[str, list[str]]) -> DataFrame:
    """Potential days since the first record, until today or (short version finished)
    the phase's end; days with data and their percentage per group of types."""
    days = sensor.withColumn("day", F.to_date("startTimestamp")).groupBy("customer").agg(
        F.min("day").alias("first_day"),
        *[F.countDistinct(F.when(F.col("type").isin(*types), F.col("day"))).alias(f"{g}_actual_days_with_data") for g, types in groups.items()],
    )
    short = (F.col("status") == FINISHED) & F.col("study_version").isin(*SHORT_VERSIONS)
    last = F.when(F.coalesce(short, F.lit(False)), F.col("ema_base_end")).otherwise(F.lit(today))
    found = days.join(roster, "customer", "left").withColumn("potential_days_coverage", F.date_diff(last, "first_day"))
    share = lambda g: F.try_divide(F.col(f"{g}_actual_days_with_data"), F.nullif("potential_days_coverage", F.lit(0))) * 100
    return found.withColumns({f"{g}_data_coverage_per": share(g) for g in groups}).drop("first_day")


def last_seen(df: DataFrame, types: list[str], name: str) -> DataFrame:
    return df.where(F.col("type").isin(*types)).groupBy("customer").agg(F.max("startTimestamp").alias(name))


#: Sketches hold up to 2**K registers: 1.6 % standard error beyond a few hundred values.
SKETCH_K = 12


def daily_sketches(sensor: DataFrame) -> DataFrame:
    """type, day, people: a mergeable sketch of the participants with records, per day.
    A new day is one more row; no earlier day is read again."""
    days = sensor.where(F.col("startTimestamp").isNotNull()).groupBy("type", F.to_date("startTimestamp").alias("day"))
    return days.agg(F.hll_sketch_agg("customer", SKETCH_K).alias("people"))


def participants_over_time(sketches: DataFrame, days: int) -> DataFrame:
    """type, upto, participants, person_days: distinct participants in the ``days`` days
    up to each day that has records of any type, and the sum of the daily numbers, from
    sketches alone.  Estimates: within 5 % in all but 3 of 1,000 cases."""
    ends = sketches.select(F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("back"), "type", "day", "people")
    known = sketches.select(F.col("day").alias("upto")).distinct()
    spread = ends.withColumn("upto", F.date_add("day", F.col("back"))).join(known, "upto")
    daily = F.sum(F.hll_sketch_estimate("people")).alias("person_days")
    return spread.groupBy("type", "upto").agg(F.hll_sketch_estimate(F.hll_union_agg("people")).alias("participants"), daily)


def daily_participants(sensor: DataFrame) -> DataFrame:
    """type, day, customer: each participant once for each day with records of a type, and
    a row without customer for records that name none.
    A new day is more rows; no earlier day is read again."""
    days = sensor.where(F.col("startTimestamp").isNotNull())
    return days.select("type", F.to_date("startTimestamp").alias("day"), "customer").distinct()


def exact_participants_over_time(daily: DataFrame, days: int) -> DataFrame:
    """type, upto, participants, person_days: as ``participants_over_time``, exactly.

    A participant counts from a day with records for ``days`` days, or until the next
    such day, from which on that one counts; so a day needs only the sums of those who
    come and go, and what is summed over days is a row for each type and day.  Records
    without customer count for nobody, but their days and types have rows.
    """
    later = F.lead("day").over(Window.partitionBy("type", "customer").orderBy("day"))
    spans = daily.withColumn("gone", F.least(F.date_add("day", days), F.coalesce(later, F.date_add("day", days))))
    named = F.col("customer").isNotNull().cast("int")
    come = F.struct(F.col("day").alias("at"), F.lit(1).alias("seen"), named.alias("n"), named.alias("own"))
    go = F.struct(F.col("gone").alias("at"), F.lit(-1).alias("seen"), (-named).alias("n"), F.lit(0).alias("own"))
    moved = spans.select("type", F.inline(F.array(come, go))).groupBy("type", "at").agg(*[F.sum(c).alias(c) for c in ("seen", "n", "own")])
    known = daily.select(F.col("day").alias("upto")).distinct()
    # Every type on every day that any has records: what came and went until then.
    met = known.join(moved, F.col("at") <= F.col("upto")).groupBy("type", "upto")
    within = F.when(F.col("at") > F.date_sub("upto", days), F.col("own")).otherwise(0)
    found = met.agg(F.sum("n").alias("participants"), F.sum(within).alias("person_days"), F.sum("seen").alias("seen"))
    return found.where("seen > 0").drop("seen")
