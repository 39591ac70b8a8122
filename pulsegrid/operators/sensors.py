"""Cleaning of sensor records and their features per prompt block."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import ACTIVITY_CODES
from ..functions.scalars import haversine, seconds_between
from .intervals import overlap_join, point_in_block_join

#: Output of blocks that no record matched.
MISSING = -1
BLOCK = ["customer", "unique_blocks"]


def filter_types(df: DataFrame, types: Iterable[str], negate: bool = False) -> DataFrame:
    own = F.col("type").isin(*types)
    return df.where(~own if negate else own)


def clean_heart_rate_data(df: DataFrame, value: str = "longValue", low: float = 30, high: float = 220) -> DataFrame:
    return df.withColumn(value, F.col(value).try_cast("double")).where(F.col(value).between(low, high))


def heart_rate_cleaning_report(df: DataFrame, value: str = "longValue", low: float = 30, high: float = 220) -> DataFrame:
    """Rows that each rule removes, in one pass."""
    v = F.col(value).try_cast("double")
    return df.agg(
        F.count("*").alias("n_rows"), F.count_if(v.isNull()).alias("n_not_numeric"), F.count_if(v < low).alias("n_low"),
        F.count_if(v > high).alias("n_high"), F.count_if(v.between(low, high)).alias("n_kept"),
    )


def _step_rules(value: str, most: float):
    v, seconds = F.col(value).try_cast("double"), seconds_between("startTimestamp", "endTimestamp")
    return v, seconds, F.try_divide(v, seconds / 60) > most


def clean_step_data(df: DataFrame, value: str = "doubleValue", most: float = 200) -> DataFrame:
    """Numeric, not negative, with a duration, and at most so many steps a minute."""
    v, seconds, fast = _step_rules(value, most)
    return df.where((v >= 0) & (seconds > 0) & ~fast).withColumn(value, v)


def step_cleaning_report(df: DataFrame, value: str = "doubleValue", most: float = 200) -> DataFrame:
    """Rows that each rule removes after the rules before it, in one pass."""
    v, seconds, fast = _step_rules(value, most)
    sound = v.isNotNull() & (v >= 0)
    return df.agg(
        F.count("*").alias("n_rows"), F.count_if(v.isNull()).alias("n_not_numeric"), F.count_if(v < 0).alias("n_negative"),
        F.count_if(sound & (F.coalesce(seconds, F.lit(0.0)) <= 0)).alias("n_no_duration"),
        F.count_if(sound & (seconds > 0) & fast).alias("n_fast"), F.count_if(sound & (seconds > 0) & ~fast).alias("n_kept"),
    )


def _on_blocks(blocks: DataFrame, found: DataFrame, fill: dict) -> DataFrame:
    """Block rows with features; blocks without a match get the fill values."""
    joined = blocks.select(*BLOCK).distinct().join(found, BLOCK, "left")
    return joined.select(*BLOCK, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in fill.items()])


def usable_readings(sensor: DataFrame) -> DataFrame:
    """customer, type, startTimestamp, endTimestamp, value: the heart rates and steps
    that cleaning keeps, and all activity records, in one pass."""
    beats = F.col("longValue").try_cast("double")
    steps, seconds, fast = _step_rules("doubleValue", 200)
    kind = F.col("type")
    kept = F.when(kind == "HeartRate", beats.between(30, 220)).when(kind == "Steps", (steps >= 0) & (seconds > 0) & ~fast).when(kind == "ActivityType", True)
    value = F.when(kind == "Steps", steps).otherwise(beats)
    return sensor.where(kept).select("customer", "type", "startTimestamp", "endTimestamp", value.alias("value"))


def reading_features() -> dict[str, Column]:
    """Features of a block as aggregates over its pairs with ``usable_readings``
    (overlap_seconds: their overlap); -1 without records of the kind."""
    kind, v, minutes = F.col("type"), F.col("value"), F.col("overlap_seconds") / 60
    beat, step, act = kind == "HeartRate", kind == "Steps", kind == "ActivityType"
    total = lambda test, what: F.sum(F.when(test, what).otherwise(0.0))
    share = F.try_divide(F.col("overlap_seconds"), seconds_between("startTimestamp", "endTimestamp"))
    own = lambda test, found, none: F.when(F.count_if(test) > 0, found).otherwise(F.lit(none))
    none = float(MISSING)
    found = {"hr_mean": F.avg(F.when(beat, v)), "hr_min": F.min(F.when(beat, v)), "hr_max": F.max(F.when(beat, v)), "hr_std": F.stddev_pop(F.when(beat, v))}
    found |= {"hr_zone_resting": total(beat & (v < 60), minutes), "hr_zone_moderate": total(beat & (v >= 60) & (v < 100), minutes), "hr_zone_vigorous": total(beat & (v >= 100), minutes)}
    found = {n: own(beat, c, none) for n, c in found.items()}
    found["n_steps"] = own(step, F.sum(F.when(step, v * share)).cast("long"), MISSING)
    return found | {f"activity_{code}_minutes": own(act, total(act & (v == code), minutes), none) for code in ACTIVITY_CODES}


def map_readings_to_ema(blocks: DataFrame, sensor: DataFrame) -> DataFrame:
    """The heart-rate, step and activity features of every block by one overlap join."""
    pairs = overlap_join(usable_readings(sensor), blocks.select(*BLOCK, "sensor_block_start", "sensor_block_end"))
    features = reading_features()
    found = pairs.groupBy(*BLOCK).agg(*[c.alias(n) for n, c in features.items()])
    return _on_blocks(blocks, found, {n: MISSING if n == "n_steps" else float(MISSING) for n in features})


def map_heart_rate_to_ema(blocks: DataFrame, sensor: DataFrame, compute_stats: bool = True, value: str = "longValue") -> DataFrame:
    """Mean, least, greatest and population deviation of the readings that touch a
    block, and minutes below 60, from 60 to 100, and from 100 beats on by overlap."""
    pairs = overlap_join(sensor.select("customer", "startTimestamp", "endTimestamp", value), blocks.select(*BLOCK, "sensor_block_start", "sensor_block_end"))
    v, minutes = F.col(value).cast("double"), F.col("overlap_seconds") / 60
    aggregates = {"hr_mean": F.avg(v)}
    if compute_stats:
        zone = lambda test: F.sum(F.when(test, minutes).otherwise(0.0))
        aggregates |= {
            "hr_min": F.min(v), "hr_max": F.max(v), "hr_std": F.stddev_pop(v),
            "hr_zone_resting": zone(v < 60), "hr_zone_moderate": zone((v >= 60) & (v < 100)), "hr_zone_vigorous": zone(v >= 100),
        }
    found = pairs.groupBy(*BLOCK).agg(*[a.alias(c) for c, a in aggregates.items()])
    return _on_blocks(blocks, found, {c: float(MISSING) for c in aggregates})


def map_steps_to_ema(blocks: DataFrame, sensor: DataFrame, value: str = "doubleValue") -> DataFrame:
    """Steps by share of overlap, cut to a whole number after the sum."""
    pairs = overlap_join(sensor.select("customer", "startTimestamp", "endTimestamp", value), blocks.select(*BLOCK, "sensor_block_start", "sensor_block_end"))
    share = F.try_divide(F.col("overlap_seconds"), seconds_between("startTimestamp", "endTimestamp"))
    found = pairs.groupBy(*BLOCK).agg(F.sum(F.col(value) * share).cast("long").alias("n_steps"))
    return _on_blocks(blocks, found, {"n_steps": MISSING})


def map_activity_types_to_ema(blocks: DataFrame, sensor: DataFrame, value: str = "longValue") -> DataFrame:
    """Overlap minutes per activity code; 0 where other codes matched."""
    pairs = overlap_join(sensor.select("customer", "startTimestamp", "endTimestamp", value), blocks.select(*BLOCK, "sensor_block_start", "sensor_block_end"))
    names = {code: f"activity_{code}_minutes" for code in ACTIVITY_CODES}
    found = pairs.groupBy(*BLOCK).agg(
        *[F.sum(F.when(F.col(value) == code, F.col("overlap_seconds") / 60).otherwise(0.0)).alias(c) for code, c in names.items()]
    )
    return _on_blocks(blocks, found, {c: float(MISSING) for c in names.values()})


def block_dwell(df: DataFrame, ts: str = "startTimestamp") -> DataFrame:
    """Seconds to the next point in the block; the last point lasts to the block's end."""
    after = F.lead(ts).over(Window.partitionBy(*BLOCK).orderBy(ts))
    return df.withColumn("dwell_seconds", seconds_between(F.col(ts), F.coalesce(after, F.col("sensor_block_end"))))


def map_gps_and_transition_to_ema(blocks: DataFrame, gps: DataFrame) -> DataFrame:
    """Points, kilometres, and minutes at home, moving and stationary per block.
    ``gps`` has Latitude, Longitude, at_home, transition and stationary (1 or 0)."""
    columns = ["customer", "startTimestamp", "Latitude", "Longitude", "at_home", "transition", "stationary"]
    pairs = block_dwell(point_in_block_join(gps.select(*columns), blocks.select(*BLOCK, "sensor_block_start", "sensor_block_end")))
    w = Window.partitionBy(*BLOCK).orderBy("startTimestamp")
    metres = haversine("Longitude", "Latitude", F.lead("Longitude").over(w), F.lead("Latitude").over(w))
    minutes = lambda flag: F.sum(F.when(F.col(flag) == 1, F.col("dwell_seconds") / 60).otherwise(0.0))
    found = (
        pairs.withColumn("metres", F.coalesce(metres, F.lit(0.0)))
        .groupBy(*BLOCK)
        .agg(
            F.count("*").alias("n_GPS"), (F.sum("metres") / 1000).alias("total_distance_km"), minutes("at_home").alias("at_home_minute"),
            minutes("transition").alias("time_in_transition_minutes"), minutes("stationary").alias("time_stationary_minutes"),
        )
    )
    m = float(MISSING)
    return _on_blocks(blocks, found, {"n_GPS": MISSING, "total_distance_km": m, "at_home_minute": m, "time_in_transition_minutes": m, "time_stationary_minutes": m})
