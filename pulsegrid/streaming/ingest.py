"""Ingest of raw sensor records as a stream, each batch in the store exactly once.

A batch of the stream is written to folders that its number names, and a row in
``done`` closes it.  A batch that was killed halfway is run again under its number
and overwrites what it had left; readers see only what is closed.  All that a batch
decides on (what is late, what is there already) it takes from the batches before it,
so a second run decides alike.

    target/store/batch=3/type=Steps/day=2024-01-05/...    new records
    target/late/batch=3/...                               records behind the watermark
    target/done/batch=3/...                               counts, newest time
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.relational import attach_roster_inner, dedupe
from ..sources.readers import clean_epochs

KEY = ["customer", "type", "startTimestamp"]
DONE = "newest timestamp, stored long, repeated long, late long, batch long"


def read_done(spark: SparkSession, target: str) -> DataFrame:
    """batch, newest, stored, repeated, late: a row for each closed batch."""
    return spark.read.schema(DONE).option("basePath", f"{target}/done").parquet(f"{target}/done")


def _closed(spark: SparkSession, target: str, name: str, before: int | None = None) -> DataFrame:
    """Rows of ``store`` (with day) or ``late`` of the closed batches (``before`` one)."""
    done, schema = read_done(spark, target), spark.read.parquet(f"{target}/schema").schema
    if before is not None:
        done = done.where(F.col("batch") < before)
    if name == "store":
        schema = StructType([*schema.fields]).add("day", "date")
    if not done.agg(F.sum("stored" if name == "store" else "late")).first()[0]:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
    rows = spark.read.schema(StructType([*schema.fields]).add("batch", "long")).option("basePath", f"{target}/{name}").parquet(f"{target}/{name}")
    return rows.join(done.select("batch"), "batch", "left_semi")


def read_store(spark: SparkSession, target: str) -> DataFrame:
    """The records of all closed batches, with type, day and batch."""
    return _closed(spark, target, "store")


def read_late(spark: SparkSession, target: str) -> DataFrame:
    """The records that came too late, as they were after cleaning, repeats included."""
    return _closed(spark, target, "late")


def close_batch(spark: SparkSession, target: str, batch: int, newest, stored: int, repeated: int, late: int) -> None:
    row = spark.createDataFrame([(newest, stored, repeated, late)], DONE.removesuffix(", batch long")).coalesce(1)
    row.write.mode("overwrite").parquet(f"{target}/done/batch={batch}")


def store_batch(rows: DataFrame, batch: int, target: str, lateness: str) -> None:
    """Adds cleaned ``rows`` as batch ``batch``: those behind the newest time of earlier
    batches by more than ``lateness`` to ``late``, the others to the store unless their
    key (customer, type, start) is there.  Of equal keys in a batch the least row counts."""
    spark = rows.sparkSession
    mark = read_done(spark, target).where(F.col("batch") < batch).agg((F.max("newest") - F.expr(f"INTERVAL '{lateness}'"))).first()[0]
    rows = rows.persist()
    behind = F.lit(False) if mark is None else F.coalesce(F.col("startTimestamp") < F.lit(mark), F.lit(False))
    span = rows.where(~behind).agg(F.count("*").alias("n"), F.max("startTimestamp").alias("high"), *[f(F.to_date("startTimestamp")).alias(n) for n, f in (("since", F.min), ("until", F.max))]).first()
    fresh = dedupe(rows.where(~behind), KEY, [c for c, t in rows.dtypes if c not in KEY and not t.startswith("map")]).withColumn("day", F.to_date("startTimestamp"))
    held = _closed(spark, target, "store", batch)
    if span.since is not None:  # the days of this batch alone are read
        held = held.where(F.col("day").isNull() | F.col("day").between(span.since, span.until))
    key = F.struct(*KEY).alias("_key")  # nulls in it are equal
    new = fresh.withColumn("_key", key).join(held.select(key), "_key", "left_anti").drop("_key").hint("rebalance", "type", "day")
    new.sortWithinPartitions("type", "day", "customer", "startTimestamp").write.mode("overwrite").partitionBy("type", "day").parquet(f"{target}/store/batch={batch}")
    rows.where(behind).write.mode("overwrite").parquet(f"{target}/late/batch={batch}")
    late = spark.read.schema(rows.schema).parquet(f"{target}/late/batch={batch}").count()
    stored = spark.read.schema("customer string").parquet(f"{target}/store/batch={batch}").count() if span.n else 0
    close_batch(spark, target, batch, span.high, stored, span.n - stored, late)
    rows.unpersist()


def stream_ingest(epochs: DataFrame, roster: DataFrame, target: str, checkpoint: str, lateness: str = "2 days", unit: str = "ms", epoch: str = "ms") -> StreamingQuery:
    """Cleans, dates and stores raw records (``readers.EPOCHS``, streaming) of the
    people in ``roster`` below ``target``; takes all that is there, then ends.  ``epoch``
    and ``unit`` are as for ``clean_epochs``.

    Result: ``read_store``, ``read_late`` and ``read_done``.  Without late records the
    store holds what ``pipelines.ingest`` gives, each key once.
    """
    cleaned, people = clean_epochs(epochs, unit, epoch), roster.dropDuplicates(["customer"])
    spark = epochs.sparkSession
    schema = attach_roster_inner(cleaned, people).schema
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{target}/schema")
    spark.createDataFrame([], DONE).write.mode("ignore").partitionBy("batch").parquet(f"{target}/done")
    return (
        cleaned.writeStream.foreachBatch(lambda rows, batch: store_batch(attach_roster_inner(rows, people), batch, target, lateness))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
