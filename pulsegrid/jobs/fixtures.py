"""Study tables derived from the driver's tables, in Spark and in SQL.

The same formulas on both sides: sensor records, prompt blocks, places and answers
from ``events``; rosters, sessions and clinical rows from customers and orders.
Blocks look back 24 hours, since users have few events each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_HOURS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("customer"),
    )


def _plus_minutes(n):
    return F.timestamp_add("MINUTE", n.cast("int"), F.col("ts"))


def sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer, type, startTimestamp, endTimestamp, doubleValue, longValue, booleanValue, stringValue."""
    e, id_ = events(spark, sf_dir), F.col("id")
    place, small = F.floor(F.col("k") / 25), F.col("k") % 25
    no = F.lit(None).cast("double")
    kind = F.col("event_type")
    rows = (
        F.when(kind == "view", F.array(_row("HeartRate", 10 * (id_ % 4), no, F.round("value").cast("long") + 20)))
        .when(kind == "click", F.array(_row("Steps", 15 * (id_ % 5), F.when(id_ % 17 == 0, -1).otherwise(1) * F.col("value") * 10, F.lit(None))))
        .when(kind == "purchase", F.array(_row("ActivityType", 20 * (id_ % 7 + 1), no, 102 + id_ % 6)))
        .when(
            kind == "signup",
            F.array(
                _row("Latitude", F.lit(0), 52.5 + 0.02 * place + 0.00001 * small, F.lit(None)),
                _row("Longitude", F.lit(0), 13.4 + 0.03 * place + 0.00001 * small, F.lit(None)),
            ),
        )
    )
    none = F.lit(None)
    return e.select("customer", F.explode(rows).alias("r")).select(
        "customer", "r.*", none.cast("boolean").alias("booleanValue"), none.cast("string").alias("stringValue")
    )


def _row(type_: str, minutes, double, long):
    return F.struct(
        F.lit(type_).alias("type"), F.col("ts").alias("startTimestamp"), _plus_minutes(minutes).alias("endTimestamp"),
        double.cast("double").alias("doubleValue"), long.cast("long").alias("longValue"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type = 'error'")
    return e.select(
        "customer", F.concat("customer", F.lit("_"), F.col("id").cast("string")).alias("unique_blocks"),
        _plus_minutes(F.lit(-60 * BLOCK_HOURS)).alias("sensor_block_start"), F.col("ts").alias("sensor_block_end"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GPS points with given cluster labels: customer, startTimestamp, Latitude, Longitude, cluster."""
    e = events(spark, sf_dir).where("event_type = 'signup'")
    place, small = F.floor(F.col("k") / 25), F.col("k") % 25
    return e.select(
        "customer", F.col("ts").alias("startTimestamp"), (52.5 + 0.02 * place + 0.00001 * small).alias("Latitude"),
        (13.4 + 0.03 * place + 0.00001 * small).alias("Longitude"), F.when(small == 24, -1).otherwise(place).cast("int").alias("cluster"),
    )


def ema_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, id_ = events(spark, sf_dir).where("event_type = 'error'"), F.col("id")
    study = F.get(F.array(*[F.lit(s) for s in (24, 25, 33, 34, 38, 39)]), (id_ % 6).cast("int"))
    return e.select(
        "customer", "id", F.col("ts").alias("quest_create"), study.alias("study"), F.concat(F.lit("panas_"), (id_ % 8).cast("string")).alias("quest_title"),
        F.when(id_ % 23 == 0, "NA").otherwise((1 + F.col("k") % 5).cast("string")).alias("choice_text"), (1 + F.col("k") % 5).alias("choice_id"),
        F.when(id_ % 29 == 0, "Questionnaire").otherwise(F.concat(F.lit("Questionnaire "), (1 + F.floor(F.hour("ts") / 4)).cast("string"))).alias("questionnaire_name"),
    )


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))
    start = F.date_add(F.lit("2024-01-01").cast("date"), (key % 7).cast("int"))
    return c.select(
        F.concat(F.lit("U"), key.cast("string")).alias("customer"), F.concat(F.lit(" FOR"), key.cast("string"), F.lit(" ")).alias("for_id"),
        pick(("Abgeschlossen", "Erhebung_1_aktiv", "Dropout"), key).alias("status"),
        pick(("Kurz", "Lang", "Kurz (Wechsel/Abbruch)", "Lang(Wechsel)"), F.col("c_nationkey")).alias("study_version"),
        pick(("ja", "nein"), key).alias("t20_post"), start.alias("ema_base_start"), F.date_add(start, 14).alias("ema_base_end"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    study = F.get(F.array(*[F.lit(s) for s in (24, 25, 33, 34, 38)]), F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    return o.select(
        F.concat(F.lit("U"), F.col("o_custkey").cast("string")).alias("customer"), F.col("o_orderdate").cast("timestamp").alias("quest_create"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("timestamp")).alias("quest_complete"), study.alias("study"),
    )


def clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded rows, two for every third customer."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    rows = c.withColumn("n", F.explode(F.when(key % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    code = lambda n: (key % n).cast("int")
    return rows.select(
        F.concat(F.lit("FOR"), key.cast("string")).alias("for_id"), F.concat(F.lit("event_"), F.col("n").cast("string")).alias("redcap_event_name"),
        F.when((F.col("n") == 1) & (key % 2 == 0), F.lit(None)).otherwise(18 + code(70)).cast("int").alias("age"), (1 + code(6)).alias("gender"),
        (1 + code(8)).alias("scid_cv_prim_cat"), code(6).alias("employability"), code(5).alias("prior_treatment"), (code(2) * F.col("n")).alias("ema_watch"),
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.groupBy(F.to_date("ts").alias("date")).agg(
        F.avg("value").alias("apparent_temperature_mean"), (F.sum("value") / 3600).alias("sunshine_duration"), F.count("*").cast("double").alias("precipitation_hours")
    )


def weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer, week, n, total, kinds: events of the first two weeks."""
    e = events(spark, sf_dir)
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    rows = e.withColumn("week", F.when(day.between(0, 7), 1).when(day.between(8, 14), 2)).where("week is not null")
    return rows.groupBy("customer", "week").agg(F.count("*").cast("double").alias("n"), F.sum("value").alias("total"), F.countDistinct("event_type").cast("double").alias("kinds"))


#: The same tables as common table expressions.
SQL = {
    "ev": "SELECT event_id AS id, ts, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, 'U' || user_id AS customer FROM events",
    "sensor": """
        SELECT customer, 'HeartRate' AS type, ts AS start, ts + to_minutes(CAST(10 * (id % 4) AS INT)) AS stop, CAST(NULL AS DOUBLE) AS dv, CAST(round(value) AS BIGINT) + 20 AS lv FROM ev WHERE event_type = 'view'
        UNION ALL SELECT customer, 'Steps', ts, ts + to_minutes(CAST(15 * (id % 5) AS INT)), CASE WHEN id % 17 = 0 THEN -1 ELSE 1 END * value * 10, NULL FROM ev WHERE event_type = 'click'
        UNION ALL SELECT customer, 'ActivityType', ts, ts + to_minutes(CAST(20 * (id % 7 + 1) AS INT)), NULL, 102 + id % 6 FROM ev WHERE event_type = 'purchase'
        UNION ALL SELECT customer, 'Latitude', ts, ts, 52.5 + 0.02 * (k // 25) + 0.00001 * (k % 25), NULL FROM ev WHERE event_type = 'signup'
        UNION ALL SELECT customer, 'Longitude', ts, ts, 13.4 + 0.03 * (k // 25) + 0.00001 * (k % 25), NULL FROM ev WHERE event_type = 'signup'""",
    "blocks": f"SELECT customer, customer || '_' || id AS unique_blocks, ts - to_hours({BLOCK_HOURS}) AS b0, ts AS b1 FROM ev WHERE event_type = 'error'",
    "places": "SELECT customer, ts, 52.5 + 0.02 * (k // 25) + 0.00001 * (k % 25) AS lat, 13.4 + 0.03 * (k // 25) + 0.00001 * (k % 25) AS lon, CASE WHEN k % 25 = 24 THEN -1 ELSE k // 25 END AS cluster FROM ev WHERE event_type = 'signup'",
    "ema": "SELECT customer, id, ts AS quest_create, [24, 25, 33, 34, 38, 39][CAST(id % 6 + 1 AS INT)] AS study, 'panas_' || (id % 8) AS quest_title, CASE WHEN id % 23 = 0 THEN 'NA' ELSE CAST(1 + k % 5 AS VARCHAR) END AS choice_text, 1 + k % 5 AS choice_id, CASE WHEN id % 29 = 0 THEN 'Questionnaire' ELSE 'Questionnaire ' || (1 + hour(ts) // 4) END AS questionnaire_name FROM ev WHERE event_type = 'error'",
    "roster": "SELECT 'U' || c_custkey AS customer, ' FOR' || c_custkey || ' ' AS for_id, ['Abgeschlossen', 'Erhebung_1_aktiv', 'Dropout'][CAST(c_custkey % 3 + 1 AS INT)] AS status, ['Kurz', 'Lang', 'Kurz (Wechsel/Abbruch)', 'Lang(Wechsel)'][CAST(c_nationkey % 4 + 1 AS INT)] AS study_version, ['ja', 'nein'][CAST(c_custkey % 2 + 1 AS INT)] AS t20_post, DATE '2024-01-01' + CAST(c_custkey % 7 AS INT) AS ema_base_start, DATE '2024-01-01' + CAST(c_custkey % 7 AS INT) + 14 AS ema_base_end FROM customer",
    "sessions": "SELECT 'U' || o_custkey AS customer, o_orderdate AS quest_create, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS quest_complete, [24, 25, 33, 34, 38][CAST(substr(o_orderpriority, 1, 1) AS INT)] AS study FROM orders",
    "clinical": "SELECT 'FOR' || c_custkey AS for_id, 'event_' || n AS event, CASE WHEN n = 1 AND c_custkey % 2 = 0 THEN NULL ELSE 18 + c_custkey % 70 END AS age, 1 + c_custkey % 6 AS gender, 1 + c_custkey % 8 AS scid_cv_prim_cat, c_custkey % 6 AS employability, c_custkey % 5 AS prior_treatment, (c_custkey % 2) * n AS ema_watch FROM customer, (VALUES (1), (2)) v(n) WHERE n = 1 OR c_custkey % 3 = 0",
    "weather": "SELECT CAST(ts AS DATE) AS date, avg(value) AS t, sum(value) / 3600 AS s, CAST(count(*) AS DOUBLE) AS p FROM ev GROUP BY 1",
    "weeks": "SELECT customer, CASE WHEN CAST(ts AS DATE) - DATE '2024-01-01' <= 7 THEN 1 ELSE 2 END AS week, CAST(count(*) AS DOUBLE) AS n, sum(value) AS total, CAST(count(DISTINCT event_type) AS DOUBLE) AS kinds FROM ev WHERE CAST(ts AS DATE) - DATE '2024-01-01' BETWEEN 0 AND 14 GROUP BY 1, 2",
}


def with_tables(query: str, *names: str) -> str:
    """``query`` after the named tables (``ev`` always first)."""
    own = ["ev", *[n for n in names if n != "ev"]]
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in own) + (", " if query.lstrip()[:5] != "SELEC" else " ") + query
