"""Readers and writers of sensor, questionnaire, roster, clinical and weather data.

All schemas are explicit, so that no file is read twice to infer them.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import apply_tz_offset, epoch_ms_to_ts, epoch_us_to_ts, normalise_customer, parse_dayfirst, parse_iso_ts, seconds_between, with_day_hour, with_duration

VALUES = "doubleValue double, longValue long, booleanValue boolean, dateValue string, stringValue string"
REST = "valueType string, createdAt long, source string, trustworthiness string, medicalGrade string, generation string"
EPOCHS = f"customer string, type string, startTimestamp long, endTimestamp long, timezoneOffset long, {VALUES}, {REST}"
BACKUP = f"customer string, type string, startTimestamp string, endTimestamp string, timezoneOffset long, {VALUES}, {REST}"

EMA_TABLES = {
    "sessions": ("user string, sessionRun string, createdAt long, completedAt long, expirationTimestamp long, study int", {"user": "customer", "createdAt": "quest_create", "completedAt": "quest_complete"}),
    "answers": ("user string, questionnaire string, study int, question string, element string, createdAt long", {"user": "customer", "createdAt": "quest_create"}),
    "choice": ("element string, choice_id int, text string, question string", {"text": "choice_text"}),
    "questions": ("id string, title string", {"id": "question", "title": "quest_title"}),
    "questionnaires": ("id string, name string", {"id": "questionnaire", "name": "questionnaire_name"}),
}

#: Headers of the monitoring sheet and the names used here.
ROSTER_HEADERS = {
    "FOR_ID": "for_id",
    "EMA_ID": "ema_id",
    "Pseudonym": "customer",
    "Studienversion": "study_version",
    "Status": "status",
    "T20=Post": "t20_post",
    "Termin 1. Gespräch": "first_call_date",
    "Start EMA Baseline": "ema_base_start",
    "Ende EMA Baseline": "ema_base_end",
    "Freischaltung/ Start EMA T20": "ema_t20_start",
    "Ende EMA T20": "ema_t20_end",
    "Freischaltung/ Start EMA Post": "ema_post_start",
    "Ende EMA Post": "ema_post_end",
}

#: Columns of the clinical exports.
CLINICAL_COLUMNS = (
    "for_id", "redcap_event_name", "basic_documentation_sheet_timestamp", "age", "gender", "scid_cv_prim_cat", "marital_status",
    "partnership", "graduation", "profession", "ema_start_date", "years_of_education", "employability", "ses", "ema_smartphone",
    "ema_sleep", "ema_watch", "prior_treatment", "ema_special_event", "psychotropic", "somatic_problems",
)
_CLINICAL_TEXT = {"for_id", "redcap_event_name", "basic_documentation_sheet_timestamp", "ema_start_date"}


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    """Sensor parts (Latin-1 CSV with epoch milliseconds) as one table."""
    return spark.read.schema(EPOCHS).option("header", True).option("encoding", "ISO-8859-1").csv(path)


def clean_epochs(epochs: DataFrame, unit: str = "ms", epoch: str = "ms") -> DataFrame:
    """Raw records with normal ids, local times, duration, day and hour, as one projection.
    ``epoch``: what their times count, ms or us; ``unit``: what their offsets count."""
    read = {"ms": epoch_ms_to_ts, "us": epoch_us_to_ts}[epoch]
    rows = epochs.drop(*[c.split()[0] for c in REST.split(", ")])
    rows = rows.withColumns({"customer": normalise_customer("customer")} | {c: read(c) for c in ("startTimestamp", "endTimestamp")})
    return with_day_hour(with_duration(apply_tz_offset(rows, unit)))


def read_backups(spark: SparkSession, path: str) -> DataFrame:
    """Backup CSVs with ISO-8601 times; ``date`` and ``index`` from ``*_<date>_<n>.csv``."""
    name = F.col("_metadata.file_name")
    pattern = r"_(\d{4}-\d{2}-\d{2})_(\d+)\.csv"
    df = spark.read.schema(BACKUP).option("header", True).csv(path)
    return df.withColumns(
        {
            "startTimestamp": parse_iso_ts("startTimestamp"),
            "endTimestamp": parse_iso_ts("endTimestamp"),
            "date": F.regexp_extract(name, pattern, 1).try_cast("date"),
            "index": F.regexp_extract(name, pattern, 2).try_cast("int"),
        }
    )


def read_ema_export(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The five questionnaire tables by name, with the columns used and canonical names."""
    found = {}
    for name, (schema, names) in EMA_TABLES.items():
        df = spark.read.schema(schema).option("header", True).csv(f"{folder}/{name}.csv")
        found[name] = df.withColumnsRenamed(names)
    return found


def canonical_roster(df: DataFrame) -> DataFrame:
    """Canonical names, trimmed ids, four-character pseudonyms, dates."""
    known = {a: b for a, b in ROSTER_HEADERS.items() if a in df.columns}
    df = df.select(*[F.col(f"`{a}`").alias(b) for a, b in known.items()])
    dates = [c for c in df.columns if c.startswith("ema_") and c != "ema_id" or c == "first_call_date"]
    return df.withColumns(
        {"customer": normalise_customer("customer"), "for_id": F.trim("for_id")} | {c: parse_dayfirst(c) for c in dates}
    )


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    return canonical_roster(spark.read.option("header", True).csv(path))


def read_clinical(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Clinical exports, appended; only the columns used."""
    kinds = {c: "string" if c in _CLINICAL_TEXT else "double" for c in CLINICAL_COLUMNS}
    parts = []
    for path in paths:
        df = spark.read.option("header", True).csv(path)
        parts.append(df.select(*[F.col(c).try_cast(k).alias(c) for c, k in kinds.items()]))
    return reduce(DataFrame.unionByName, parts)


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """Daily weather; sunshine from seconds to hours."""
    df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).csv(path)
    return df.select(
        F.to_date("date").alias("date"),
        F.col("apparent_temperature_mean").try_cast("double").alias("apparent_temperature_mean"),
        (F.col("sunshine_duration").try_cast("double") / 3600).alias("sunshine_duration"),
        F.col("precipitation_hours").try_cast("double").alias("precipitation_hours"),
    )


def write_dataset(df: DataFrame, path: str, mode: str = "append", ts: str = "startTimestamp") -> None:
    """Sensor store: partitioned by type and day, so that both prune; within a file rows
    lie by customer and time.  The rows of a type and day go to as many tasks and files
    as their size asks for."""
    day = df.withColumn("day", F.to_date(ts)).hint("rebalance", "type", "day")
    day.sortWithinPartitions("type", "day", "customer", ts).write.mode(mode).partitionBy("type", "day").parquet(path)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def compact_bucketed(store: DataFrame, path: str, buckets: int = 256, ts: str = "startTimestamp") -> DataFrame:
    """The records of a store in ``buckets`` files by participant, each in time order;
    read as a table that knows it, so that sums, windows and joins per participant need
    no exchange and no sort.  Small files of many batches become one a bucket."""
    spark = store.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    by_customer = store.repartition(buckets, "customer")
    by_customer.write.bucketBy(buckets, "customer").sortBy("customer", ts).option("path", path).saveAsTable(name)
    return spark.table(name)


def longest_gaps(bucketed: DataFrame, value: str = "longValue", ts: str = "startTimestamp") -> DataFrame:
    """customer, n, mean, gap: records, their mean value and the longest time between two."""
    before = F.lag(ts).over(Window.partitionBy("customer").orderBy(ts))
    rows = bucketed.select("customer", value, seconds_between(before, F.col(ts)).alias("seconds"))
    return rows.groupBy("customer").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max("seconds").alias("gap"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
