"""Interval-overlap joins per customer, by time buckets.

An overlap condition alone would pair every record of a customer with every block.
Both sides are dealt to the time buckets that they touch and joined on (customer,
bucket): a hot customer is spread over its time line.  A pair that shares several
buckets is kept in the first shared one only, so there are no duplicates to drop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_SECONDS = 7_200
#: Records over more buckets than this are joined on buckets this much coarser.
LONG = 48


def _seconds(c: str) -> Column:
    return F.unix_seconds(F.col(c).cast("timestamp"))


def _dealt(df: DataFrame, start: str, end: str, seconds: int, prefix: str) -> DataFrame:
    first, last = F.floor(_seconds(start) / seconds), F.floor(_seconds(end) / seconds)
    sound = df.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
    return sound.withColumn(f"{prefix}_first", first).withColumn("_bucket", F.explode(F.sequence(first, last)))


def _joined(sensor: DataFrame, blocks: DataFrame, start: str, end: str, b_start: str, b_end: str, key: str, seconds: int) -> DataFrame:
    s, b = _dealt(sensor, start, end, seconds, "_s"), _dealt(blocks, b_start, b_end, seconds, "_b")
    meets = (F.col(start) <= F.col(b_end)) & (F.col(end) >= F.col(b_start))
    once = F.col("_bucket") == F.greatest("_s_first", "_b_first")
    return s.join(b, [key, "_bucket"]).where(meets & once).drop("_bucket", "_s_first", "_b_first")


def overlap_join(sensor: DataFrame, blocks: DataFrame, start: str = "startTimestamp", end: str = "endTimestamp", b_start: str = "sensor_block_start", b_end: str = "sensor_block_end", key: str = "customer", seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Pairs of record and block of one customer that touch, both ends closed, with
    the overlap's start, end and seconds.  Null or reversed intervals match nothing."""
    span = _seconds(end) - _seconds(start)
    short = _joined(sensor.where(span <= LONG * seconds), blocks, start, end, b_start, b_end, key, seconds)
    long = _joined(sensor.where(span > LONG * seconds), blocks, start, end, b_start, b_end, key, LONG * seconds)
    low, high = F.greatest(start, b_start), F.least(end, b_end)
    micros = F.unix_micros(high.cast("timestamp")) - F.unix_micros(low.cast("timestamp"))
    return short.unionByName(long).withColumns({"overlap_start": low, "overlap_end": high, "overlap_seconds": micros / F.lit(1_000_000.0)})


def point_in_block_join(points: DataFrame, blocks: DataFrame, ts: str = "startTimestamp", b_start: str = "sensor_block_start", b_end: str = "sensor_block_end", key: str = "customer", seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Pairs of point and block of one customer with the point in the closed block."""
    p = points.withColumn("_bucket", F.floor(_seconds(ts) / seconds))
    b = _dealt(blocks, b_start, b_end, seconds, "_b").drop("_b_first")
    return p.join(b, [key, "_bucket"]).where(F.col(ts).between(F.col(b_start), F.col(b_end))).drop("_bucket")


def prefilter_time_range(sensor: DataFrame, blocks: DataFrame, start: str = "startTimestamp", end: str = "endTimestamp", key: str = "customer") -> DataFrame:
    """Records that reach into their customer's span of blocks."""
    span = blocks.groupBy(key).agg(F.min("sensor_block_start").alias("_low"), F.max("sensor_block_end").alias("_high"))
    return sensor.join(span, key).where((F.col(end) >= F.col("_low")) & (F.col(start) <= F.col("_high"))).drop("_low", "_high")
