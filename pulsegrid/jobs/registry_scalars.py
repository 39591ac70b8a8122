"""Queries on column functions, joins, sets and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import P, codes, fx, query, r6, relational, rounded, stamp, with_tables


@query("p1_normalise_customer", "SELECT c_custkey, trim(substr(split_part('  ' || c_custkey || 'abcd@x.org', '@', 1), 1, 4)) AS customer FROM customer")
def _(spark, sf):
    c = fx.table(spark, sf, "customer")
    return c.select("c_custkey", P.normalise_customer(F.concat(F.lit("  "), F.col("c_custkey").cast("string"), F.lit("abcd@x.org"))).alias("customer"))


@query("p2_epoch_ms_to_ts", with_tables("SELECT id, strftime(make_timestamp((epoch_us(ts) // 1000) * 1000), '%Y-%m-%d %H:%M:%S') AS at FROM ev"))
def _(spark, sf):
    e = fx.events(spark, sf)
    return e.select("id", P.epoch_ms_to_ts(F.floor(F.unix_micros("ts") / 1000)).alias("t")).select("id", stamp("t").alias("at"))


@query("p3_parse_iso_ts", with_tables("SELECT id, CASE WHEN id % 7 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at FROM ev"))
def _(spark, sf):
    text = F.when(F.col("id") % 7 == 0, "no time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return fx.events(spark, sf).select("id", P.parse_iso_ts(text).alias("t")).select("id", stamp("t").alias("at"))


@query("p4_apply_tz_offset", with_tables("SELECT id, strftime(ts + to_minutes(CAST(CASE WHEN id % 5 = 0 THEN 0 ELSE 60 END AS INT)), '%Y-%m-%d %H:%M:%S') AS zero, CASE WHEN id % 5 <> 0 THEN strftime(ts + to_minutes(60), '%Y-%m-%d %H:%M:%S') END AS null_ FROM ev"))
def _(spark, sf):
    e = fx.events(spark, sf).withColumn("timezoneOffset", F.when(F.col("id") % 5 != 0, F.lit(60))).withColumn("ts2", F.col("ts"))
    df = P.apply_tz_offset(e, "min", "zero", ("ts",))
    df = P.apply_tz_offset(df, "min", "null", ("ts2",))
    return df.select("id", stamp("ts").alias("zero"), stamp("ts2").alias("null_"))


@query("p5_truncate_seconds", with_tables("SELECT id, epoch_us(date_trunc('second', ts)) AS micros FROM ev"))
def _(spark, sf):
    return fx.events(spark, sf).select("id", F.unix_micros(P.truncate_seconds("ts")).alias("micros"))


@query("p6_p7_duration_day_hour", with_tables("SELECT customer, type, strftime(start, '%Y-%m-%d') AS day, CAST(hour(start) AS INT) AS hour, round((epoch_us(stop) - epoch_us(start)) / 1e6, 6) AS start_end FROM sensor", "sensor"))
def _(spark, sf):
    df = P.with_day_hour(P.with_duration(fx.sensor(spark, sf)))
    return df.select("customer", "type", F.col("startTimestamp_day").cast("string").alias("day"), F.col("startTimestamp_hour").alias("hour"), r6("start_end").alias("start_end"))


@query("p8_fill_missing", with_tables("SELECT id, CASE WHEN id % 3 = 0 THEN '-99' ELSE event_type END AS event_type, CASE WHEN id % 4 = 0 THEN 'false' ELSE 'true' END AS flag FROM ev"))
def _(spark, sf):
    e = fx.events(spark, sf).select("id", F.when(F.col("id") % 3 != 0, F.col("event_type")).alias("event_type"), F.when(F.col("id") % 4 != 0, F.lit(True)).alias("flag"))
    return P.fill_missing(e, ["event_type"], ["flag"])


@query("p9_parse_dayfirst", with_tables("SELECT id, strftime(ts, '%Y-%m-%d') AS day FROM ev"))
def _(spark, sf):
    text = F.concat(F.when(F.col("id") % 2 == 0, "Mo, ").otherwise(""), F.date_format("ts", "dd.MM.yyyy"))
    return fx.events(spark, sf).select("id", P.parse_dayfirst(text).cast("string").alias("day"))


_CAL = "dayname({0}) AS weekday, CASE WHEN isodow({0}) >= 6 THEN 1 ELSE 0 END AS weekend, CASE WHEN month({0}) IN (3, 4, 5) THEN 'Spring' WHEN month({0}) IN (6, 7, 8) THEN 'Summer' WHEN month({0}) IN (9, 10, 11) THEN 'Fall' ELSE 'Winter' END AS season, CASE WHEN hour({0}) BETWEEN 5 AND 7 THEN 'Early Morning' WHEN hour({0}) BETWEEN 8 AND 11 THEN 'Morning' WHEN hour({0}) BETWEEN 12 AND 16 THEN 'Afternoon' WHEN hour({0}) BETWEEN 17 AND 20 THEN 'Evening' ELSE 'Night' END AS time_of_day"


@query("p10_calendar_features", "SELECT o_orderkey, " + _CAL.format("t") + " FROM (SELECT o_orderkey, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) AS t FROM orders)")
def _(spark, sf):
    return P.calendar_features(_order_times(spark, sf), "t").drop("t")


def _order_times(spark, sf):
    o = fx.table(spark, sf, "orders")
    return o.select("o_orderkey", F.timestamp_add("HOUR", (F.col("o_orderkey") % 24).cast("int"), F.col("o_orderdate").cast("timestamp")).alias("t"))


@query("p11_calendar_features_doy", "SELECT o_orderkey, CASE WHEN hour(t) BETWEEN 5 AND 11 THEN 'morning' WHEN hour(t) BETWEEN 12 AND 13 THEN 'noon' WHEN hour(t) BETWEEN 14 AND 17 THEN 'afternoon' ELSE 'evening' END AS time_of_day, CASE WHEN dayofyear(t) BETWEEN 80 AND 171 THEN 'spring' WHEN dayofyear(t) BETWEEN 172 AND 263 THEN 'summer' WHEN dayofyear(t) BETWEEN 264 AND 354 THEN 'fall' ELSE 'winter' END AS season FROM (SELECT o_orderkey, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) AS t FROM orders)")
def _(spark, sf):
    return P.calendar_features_doy(_order_times(spark, sf), "t").drop("t")


@query("p12_study_phase", with_tables("SELECT study, CASE WHEN study IN (24, 25) THEN 0 WHEN study IN (33, 34) THEN 1 WHEN study IN (38, 39) THEN 2 END AS phase, count(*) AS n FROM ema GROUP BY ALL", "ema"))
def _(spark, sf):
    return fx.ema_long(spark, sf).groupBy("study", P.study_phase("study").alias("phase")).agg(F.count("*").alias("n"))


_NQ = "TRY_CAST(nullif(regexp_extract(questionnaire_name, '([0-9]+)', 1), '') AS DOUBLE)"


@query("p13_questionnaire_number", with_tables(f"SELECT questionnaire_name, {_NQ} AS number, replace(quest_title || '_morning', '_morning', '') AS title, count(*) AS n FROM ema GROUP BY ALL", "ema"))
def _(spark, sf):
    e = fx.ema_long(spark, sf)
    title = P.plain_title(F.concat("quest_title", F.lit("_morning")))
    return e.groupBy("questionnaire_name", P.questionnaire_number("questionnaire_name").alias("number"), title.alias("title")).agg(F.count("*").alias("n"))


@query("p14_unique_day_id", with_tables(f"SELECT id, strftime(quest_create, '%Y%m%d') || '_' || coalesce(CAST({_NQ} AS VARCHAR), 'unknown') AS unique_day_id FROM ema", "ema"))
def _(spark, sf):
    return fx.ema_long(spark, sf).select("id", P.unique_day_id("quest_create", P.questionnaire_number("questionnaire_name")).alias("unique_day_id"))


def _case(c: str, mapping: dict) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in mapping.items()) + " END"


@query("p15_decode", with_tables(f"SELECT for_id, event, {_case('gender', codes.GENDER)} AS gender, {_case('scid_cv_prim_cat', codes.DIAGNOSIS)} AS diagnosis, {_case('employability', codes.EMPLOYABILITY_SIMPLE)} AS employability, {_case('prior_treatment', codes.PRIOR_TREATMENT_SIMPLE)} AS prior FROM clinical", "clinical"))
def _(spark, sf):
    c = fx.clinical(spark, sf)
    return c.select(
        "for_id", F.col("redcap_event_name").alias("event"), P.decode("gender", codes.GENDER).alias("gender"), P.decode("scid_cv_prim_cat", codes.DIAGNOSIS).alias("diagnosis"),
        P.decode("employability", codes.EMPLOYABILITY_SIMPLE).alias("employability"), P.decode("prior_treatment", codes.PRIOR_TREATMENT_SIMPLE).alias("prior"),
    )


@query("p16_age_buckets", with_tables("SELECT for_id, event, CASE WHEN age < 25 THEN '18 to 25' WHEN age < 35 THEN '25 to 34' WHEN age < 45 THEN '35 to 44' WHEN age < 55 THEN '45 to 54' WHEN age < 65 THEN '55 to 64' WHEN age < 75 THEN '65 to 74' WHEN age < 85 THEN '75 to 84' WHEN age >= 85 THEN 'Greater than 85' ELSE 'Not answered' END AS bucket, CASE WHEN age BETWEEN 18 AND 24 THEN 0 WHEN age BETWEEN 25 AND 34 THEN 1 WHEN age BETWEEN 35 AND 44 THEN 2 WHEN age BETWEEN 45 AND 54 THEN 3 WHEN age BETWEEN 55 AND 64 THEN 4 ELSE 5 END AS code FROM clinical", "clinical"))
def _(spark, sf):
    return fx.clinical(spark, sf).select("for_id", F.col("redcap_event_name").alias("event"), P.age_bucket("age").alias("bucket"), P.age_code("age").alias("code"))


@query("p20_filter_status_phase", with_tables("SELECT 'roster' AS part, count(*) AS n FROM roster WHERE status IN ('Abgeschlossen') UNION ALL SELECT 'ema', count(*) FROM ema WHERE study IN (33, 34)", "roster", "ema"))
def _(spark, sf):
    n = lambda df, part: df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
    return n(relational.filter_status(fx.roster(spark, sf), ["Abgeschlossen"]), "roster").unionByName(n(relational.filter_phase(fx.ema_long(spark, sf), [33, 34]), "ema"))


@query("p21_clip_to_phase", with_tables("SELECT s.customer, s.type, count(*) AS n FROM sensor s JOIN roster r USING (customer) WHERE s.start <= r.ema_base_end + INTERVAL 1 DAY GROUP BY ALL", "sensor", "roster"))
def _(spark, sf):
    df = relational.attach_roster_inner(fx.sensor(spark, sf), fx.roster(spark, sf))
    return relational.clip_to_phase(df).groupBy("customer", "type").agg(F.count("*").alias("n"))


@query("p22_exclude_rows", with_tables("SELECT count(*) AS n FROM ema WHERE NOT (customer = 'U1' AND study = 24 AND quest_create >= TIMESTAMP '2024-01-10') AND NOT (customer = 'U3' AND study = 33 AND quest_create >= TIMESTAMP '2024-01-02')", "ema"))
def _(spark, sf):
    return relational.exclude_rows(fx.ema_long(spark, sf), [("U1", 24, "2024-01-10"), ("U3", 33, "2024-01-02")]).agg(F.count("*").alias("n"))


@query("p24_numeric_items", with_tables("SELECT id, TRY_CAST(choice_text AS DOUBLE) AS choice_text FROM ema WHERE TRY_CAST(choice_text AS DOUBLE) IS NOT NULL", "ema"))
def _(spark, sf):
    return relational.numeric_items(fx.ema_long(spark, sf).select("id", "choice_text"), ["choice_text"])


@query("p29_p30_haversine", with_tables("SELECT customer, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, round(2 * 6371000 * atan2(sqrt(a), sqrt(1 - a)), 3) AS metres, 2 * 6371000 * atan2(sqrt(a), sqrt(1 - a)) < 30 AS near FROM (SELECT *, pow(sin(radians(52.5 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(52.5)) * pow(sin(radians(13.4 - lon) / 2), 2) AS a FROM places)", "places"))
def _(spark, sf):
    p = fx.places(spark, sf)
    home = F.lit(13.4), F.lit(52.5)
    return p.select(
        "customer", stamp("startTimestamp").alias("at"), F.round(P.haversine("Longitude", "Latitude", *home), 3).alias("metres"),
        P.isclose("Latitude", "Longitude", home[1], home[0]).alias("near"),
    )


@query("p31_logs", with_tables("SELECT id, round(ln(1 + greatest(value - 50, -0.999)), 6) AS logged, round(ln(value - 50 + (SELECT CASE WHEN min(value - 50) <= 0 THEN abs(min(value - 50)) + 1 ELSE 0 END FROM ev)), 6) AS shifted FROM ev"))
def _(spark, sf):
    e = fx.events(spark, sf).withColumn("v", F.col("value") - 50)
    return rounded(P.normalize_data(e, "v", "shifted").select("id", P.safe_log1p("v").alias("logged"), "shifted"))


def _items(spark, sf):
    k = F.col("k")
    return fx.events(spark, sf).select("id", *[F.when((k + i) % 11 != 0, (k + i) % 5).cast("double").alias(f"bsi_{i}") for i in range(1, 54)])


_BSI = lambda items: " + ".join(f"(CASE WHEN (k + {i}) % 11 <> 0 THEN (k + {i}) % 5 ELSE 0 END)" for i in items)


@query("p32_scale_scores", with_tables("SELECT id, " + ", ".join(f"CAST({_BSI(v)} AS DOUBLE) AS {n}" for n, v in codes.BSI_SCALES.items()) + f", CAST({_BSI(range(1, 54))} AS DOUBLE) AS bsi_gs, round(({_BSI(range(1, 54))}) / 53.0, 6) AS bsi_gsi FROM ev"))
def _(spark, sf):
    scales = {n: [f"bsi_{i}" for i in v] for n, v in codes.BSI_SCALES.items()} | {"bsi_gs": [f"bsi_{i}" for i in range(1, 54)]}
    df = P.scale_scores(_items(spark, sf), scales).withColumn("bsi_gsi", r6(F.col("bsi_gs") / 53))
    return df.select("id", *scales, "bsi_gsi")


@query("p33_clinical_outcome", "WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN abs(c_acctbal) / 3000 END AS b, (c_custkey % 7) / 4.0 AS t FROM customer), v AS (SELECT * FROM s WHERE b IS NOT NULL AND t <> 0), r AS (SELECT *, (t - b) * sqrt(2) / (SELECT stddev_samp(b) FROM v) AS rci FROM v) SELECT c_custkey, round(t - b, 6) AS change, round(rci, 6) AS rci, t < 0.56 AS significant, abs(rci) >= 1.96 AS reliable, CASE WHEN t < 0.56 AND abs(rci) >= 1.96 THEN 1 ELSE 0 END AS both FROM r")
def _(spark, sf):
    c = fx.table(spark, sf, "customer")
    df = c.select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.abs("c_acctbal") / 3000).alias("bsi_gsi_base"), ((F.col("c_custkey") % 7) / 4.0).alias("bsi_gsi_t20"))
    return rounded(P.clinical_outcome(df).select("c_custkey", F.col("bsi_gsi_change").alias("change"), "rci", F.col("clinically_significant").alias("significant"), F.col("reliable_change").alias("reliable"), F.col("clinically_reliable_change").alias("both")))


# -- joins -------------------------------------------------------------------


@query("j1_build_ema_long", "SELECT p_brand, s_name, n_name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL")
def _(spark, sf):
    from ..operators import ema

    t = lambda n: fx.table(spark, sf, n)
    answers = t("lineitem").select(F.col("l_partkey").alias("element"), F.col("l_suppkey").alias("question"))
    # choice is keyed by both, as in the study's tables: one row per (question, element) met.
    choice = answers.distinct().join(t("part").select(F.col("p_partkey").alias("element"), "p_brand"), "element")
    questions = t("supplier").select(F.col("s_suppkey").alias("question"), "s_name", F.col("s_nationkey").alias("questionnaire"))
    names = t("nation").select(F.col("n_nationkey").alias("questionnaire"), "n_name")
    return ema.build_ema_long(answers, choice, questions, names).groupBy("p_brand", "s_name", "n_name").agg(F.count("*").alias("n"))


@query("j2_attach_roster", with_tables("SELECT r.customer, r.status, s.type, count(*) AS n FROM sensor s RIGHT JOIN roster r USING (customer) GROUP BY ALL", "sensor", "roster"))
def _(spark, sf):
    return relational.attach_roster(fx.sensor(spark, sf), fx.roster(spark, sf)).groupBy("customer", "status", "type").agg(F.count("*").alias("n"))


@query("j3_attach_roster_inner", with_tables("SELECT status, count(*) AS n FROM ema JOIN roster USING (customer) GROUP BY 1", "ema", "roster"))
def _(spark, sf):
    return relational.count_by(relational.attach_roster_inner(fx.ema_long(spark, sf), fx.roster(spark, sf)), "status")


@query("j8_keep_drop_customers", with_tables("SELECT 'keep' AS part, count(*) AS n FROM sensor WHERE customer IN (SELECT customer FROM roster) UNION ALL SELECT 'drop', count(*) FROM sensor WHERE customer NOT IN (SELECT customer FROM roster WHERE status = 'Dropout')", "sensor", "roster"))
def _(spark, sf):
    s, r = fx.sensor(spark, sf), fx.roster(spark, sf)
    n = lambda df, part: df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
    return n(relational.keep_customers(s, r), "keep").unionByName(n(relational.drop_customers(s, relational.filter_status(r, ["Dropout"])), "drop"))


@query("j9_attach_static", with_tables("SELECT unique_blocks, status, study_version FROM blocks LEFT JOIN roster USING (customer)", "blocks", "roster"))
def _(spark, sf):
    return relational.attach_static(fx.blocks(spark, sf), fx.roster(spark, sf)).select("unique_blocks", "status", "study_version")


@query("j10_attach_weather", with_tables("SELECT unique_blocks, round(t, 6) AS apparent_temperature_mean, round(s, 6) AS sunshine_duration, p AS precipitation_hours FROM blocks LEFT JOIN weather ON CAST(b1 AS DATE) = weather.date", "blocks", "weather"))
def _(spark, sf):
    df = relational.attach_weather(fx.blocks(spark, sf), fx.weather(spark, sf))
    return rounded(df.select("unique_blocks", "apparent_temperature_mean", "sunshine_duration", "precipitation_hours"))


@query("j12_merge_counts", with_tables("SELECT r.customer, a.n AS n_hr, b.n AS n_steps FROM roster r LEFT JOIN (SELECT customer, count(*) AS n FROM sensor WHERE type = 'HeartRate' GROUP BY 1) a USING (customer) LEFT JOIN (SELECT customer, count(*) AS n FROM sensor WHERE type = 'Steps' GROUP BY 1) b USING (customer)", "roster", "sensor"))
def _(spark, sf):
    s = fx.sensor(spark, sf)
    n = lambda t, c: s.where(F.col("type") == t).groupBy("customer").agg(F.count("*").alias(c))
    return relational.merge_counts(fx.roster(spark, sf).select("customer"), n("HeartRate", "n_hr"), n("Steps", "n_steps"))


@query("j14_week_pair_join", with_tables("SELECT a.customer, a.n AS n_first, round(a.total, 6) AS total_first, b.n AS n_second, round(b.total, 6) AS total_second FROM weeks a JOIN weeks b USING (customer) WHERE a.week = 1 AND b.week = 2", "weeks"))
def _(spark, sf):
    w = fx.weeks(spark, sf)
    pick = lambda i: w.where(F.col("week") == i).select("customer", "n", "total")
    return rounded(relational.week_pair_join(pick(1), pick(2)))


@query("j16_attach_choice_sets", with_tables("i AS (SELECT customer, strftime(quest_create, '%Y-%m-%d') AS unique_day_id, count(*) AS item FROM ema GROUP BY 1, 2), s AS (SELECT customer, strftime(ts, '%Y-%m-%d') AS unique_day_id, event_type AS situation FROM ev) SELECT s.unique_day_id, item, situation FROM i RIGHT JOIN s ON i.customer = s.customer AND i.unique_day_id = s.unique_day_id", "ema"))
def _(spark, sf):
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias("unique_day_id")
    items = fx.ema_long(spark, sf).groupBy("customer", day("quest_create")).agg(F.count("*").alias("item"))
    sets = fx.events(spark, sf).select("customer", day("ts"), F.col("event_type").alias("situation"))
    return relational.attach_choice_sets(items, sets).drop("customer")


# -- sorts, sets -------------------------------------------------------------


@query("t1_sort_by_time", with_tables("SELECT id, epoch_us(ts) AS micros FROM ev ORDER BY ts"))
def _(spark, sf):
    return relational.sort_by_time(fx.events(spark, sf), "ts", within=False).select("id", F.unix_micros("ts").alias("micros"))


@query("t2_top_k_per_group", with_tables("SELECT event_type, id, value, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, id) AS INT) AS rank FROM ev QUALIFY rank <= 3"))
def _(spark, sf):
    return relational.top_k_per_group(fx.events(spark, sf).select("event_type", "id", "value"), "event_type", "value", 3, "id")


@query("t3_top_k_values", with_tables("SELECT customer, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, customer LIMIT 5"))
def _(spark, sf):
    return relational.top_k_values(fx.events(spark, sf), "customer", 5)


@query("t4_dedupe", with_tables("SELECT customer, event_type, id FROM ev QUALIFY row_number() OVER (PARTITION BY customer, event_type ORDER BY ts, id) = 1"))
def _(spark, sf):
    return relational.dedupe(fx.events(spark, sf), ["customer", "event_type"], ["ts", "id"]).select("customer", "event_type", "id")


@query("u1_union_parts", "SELECT o_orderkey AS key, o_totalprice AS price, CAST(NULL AS BIGINT) AS part FROM orders UNION ALL SELECT l_orderkey, NULL, l_partkey FROM lineitem")
def _(spark, sf):
    o = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))
    return relational.union_parts([o, fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("part"))])


@query("u2_incremental_append", with_tables("SELECT id FROM ev WHERE event_type <> 'error' UNION ALL SELECT id FROM ev WHERE event_type = 'error' AND ts > (SELECT max(ts) FROM ev WHERE event_type <> 'error')"))
def _(spark, sf):
    e = fx.events(spark, sf)
    return relational.incremental_append(e.where("event_type <> 'error'"), e.where("event_type = 'error'"), "ts").select("id")


@query("u3_distinct_rows", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def _(spark, sf):
    return relational.distinct_rows(fx.table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag"))


@query("a25_counts", with_tables("SELECT event_type, count(DISTINCT customer) AS n_customers FROM ev GROUP BY 1"))
def _(spark, sf):
    return relational.n_customers(fx.events(spark, sf), "event_type")
