"""Structured Streaming forms of availability and block features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.availability import type_value
from ..operators.sensors import reading_features, usable_readings


def clean_stream(rows: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Each (customer, type, start) once, however late within the watermark."""
    return rows.withWatermark("startTimestamp", lateness).dropDuplicatesWithinWatermark(["customer", "type", "startTimestamp"])


def stream_hourly_availability(sensor: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Presence per customer, type and tumbling hour; append mode."""
    w = F.window("startTimestamp", "1 hour")
    hours = sensor.withWatermark("startTimestamp", lateness).groupBy(w, "customer", "type").agg(F.max(type_value()).alias("available"))
    return hours.select("customer", "type", F.col("window.start").alias("hour_start"), "available")


def stream_block_features(readings: DataFrame, prompts: DataFrame, hours: float = 2, lateness: str = "1 hour", longest: str = "1 day") -> DataFrame:
    """Heart-rate, step and activity features of the hours before each prompt, as
    streams; append mode.  ``readings`` are sensor records, ``prompts`` have customer,
    unique_blocks and sensor_block_end.

    Prompts are joined with the records that overlap their block, outer, so that those
    without any come out with -1, and a second stateful step aggregates a block.  A
    block is told once both watermarks have passed all that could still reach it.
    State is bounded by ``lateness``, ``hours`` and ``longest``, the duration of the
    longest record: one that began earlier than that before a block does not reach it.
    """
    reach = f"INTERVAL {int(hours * 3600)} SECONDS"
    r = usable_readings(readings).withColumnRenamed("customer", "r_customer").withWatermark("startTimestamp", lateness)
    p = prompts.select("customer", "unique_blocks", "sensor_block_end").withWatermark("sensor_block_end", lateness)
    end, begin = F.col("sensor_block_end"), F.col("sensor_block_end") - F.expr(reach)
    touches = (
        (F.col("r_customer") == F.col("customer"))
        & (F.col("startTimestamp") <= end)
        & (F.col("startTimestamp") >= end - F.expr(reach) - F.expr(f"INTERVAL '{longest}'"))
        & (F.col("endTimestamp") >= begin)
        & (F.col("endTimestamp") >= F.col("startTimestamp"))
    )
    micros = F.unix_micros(F.least("endTimestamp", "sensor_block_end")) - F.unix_micros(F.greatest(F.col("startTimestamp"), begin))
    pairs = p.join(r, touches, "left_outer").withColumn("overlap_seconds", micros / F.lit(1_000_000.0))
    features = [c.alias(n) for n, c in reading_features().items()]
    return pairs.groupBy("customer", "unique_blocks", "sensor_block_end").agg(*features)
