"""Queries on questionnaires, reliability, situations and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import ema, fx, linear, modelling, query, relational, reliability, rounded, scores, situations, stamp, with_tables

_NQ = "TRY_CAST(nullif(regexp_extract(questionnaire_name, '([0-9]+)', 1), '') AS DOUBLE)"
_D = f"""d AS (SELECT *, CASE WHEN study IN (24, 25) THEN 0 WHEN study IN (33, 34) THEN 1 WHEN study IN (38, 39) THEN 2 END AS assess, {_NQ} AS nq, CAST(quest_create AS DATE) AS day,
    strftime(quest_create, '%Y%m%d') || '_' || coalesce(CAST({_NQ} AS VARCHAR), 'unknown') AS unique_day_id FROM ema) """


def _sql(q: str) -> str:
    return with_tables(_D.rstrip() + (" " if q.startswith("SELECT") else ", ") + q, "ema")


def _derived(spark, sf):
    return ema.derive_ema(fx.ema_long(spark, sf))


@query("a_derive_ema", _sql("SELECT id, assess, nq AS n_questionnaire, unique_day_id, CAST(hour(quest_create) AS INT) AS quest_create_hour FROM d"))
def _(spark, sf):
    return _derived(spark, sf).select("id", "assess", "n_questionnaire", "unique_day_id", "quest_create_hour")


@query("a2_session_counts", with_tables("SELECT customer, count_if(study IN (24, 25) AND quest_create IS NOT NULL) AS n_sessions_phase0, count_if(study IN (33, 34) AND quest_create IS NOT NULL) AS n_sessions_phase1, count_if(study IN (38, 39) AND quest_create IS NOT NULL) AS n_sessions_phase2 FROM sessions GROUP BY 1", "sessions"))
def _(spark, sf):
    return ema.session_counts(fx.sessions(spark, sf))


@query("a6_n_quest", _sql("SELECT customer, strftime(day, '%Y-%m-%d') AS day, count(DISTINCT nq) AS n_quest, count(*) AS n FROM d GROUP BY 1, 2"))
def _(spark, sf):
    df = ema.n_quest(_derived(spark, sf), ["customer", "quest_create_day"])
    return df.groupBy("customer", F.col("quest_create_day").cast("string").alias("day"), "n_quest").agg(F.count("*").alias("n"))


@query("a7_compliance_gate", _sql("g AS (SELECT customer, day, count(DISTINCT unique_day_id) AS n FROM d GROUP BY 1, 2), k AS (SELECT customer, CAST(sum(n) AS BIGINT) AS n_quest_sum FROM g GROUP BY 1 HAVING count_if(n >= 2) >= 2) SELECT id, n_quest_sum FROM d JOIN k USING (customer)"))
def _(spark, sf):
    return ema.compliance_gate(_derived(spark, sf), 2, 2).select("id", "n_quest_sum")


_TITLES = [f"panas_{i}" for i in range(8)]


@query("a8_pivot_items", _sql("SELECT customer, assess, " + ", ".join(f"arg_min(CASE WHEN quest_title = '{t}' THEN choice_text END, CASE WHEN quest_title = '{t}' THEN quest_create END) AS {t}" for t in _TITLES) + " FROM d GROUP BY 1, 2"))
def _(spark, sf):
    return ema.pivot_items(_derived(spark, sf), ["customer", "assess"], _TITLES)


@query("a10_first_info", _sql("SELECT customer, unique_day_id, arg_min(study, quest_create) AS study, arg_min(questionnaire_name, quest_create) AS questionnaire_name FROM d GROUP BY 1, 2"))
def _(spark, sf):
    return ema.first_info(_derived(spark, sf), ["study", "questionnaire_name"])


@query("a11_negative_affect", with_tables("SELECT customer, CAST(id AS VARCHAR) AS unique_day_id, CAST(k AS DOUBLE) AS a, CASE WHEN id % 3 <> 0 THEN CAST(id % 10 AS DOUBLE) END AS b, round(CASE WHEN id % 3 <> 0 THEN (k + id % 10) / 2.0 ELSE k END, 6) AS mean_na FROM ev"))
def _(spark, sf):
    e = fx.events(spark, sf).select("customer", F.col("id").cast("string").alias("unique_day_id"), F.col("k").alias("a"), F.when(F.col("id") % 3 != 0, F.col("id") % 10).alias("b"))
    return rounded(ema.negative_affect(e, ["a", "b"]))


@query("a12_phase_bounds", _sql("SELECT customer, " + ", ".join(f"strftime({f}(CASE WHEN assess = {p} THEN day END), '%Y-%m-%d') AS ema_relative_{n}_phase{p}" for p in (0, 1, 2) for n, f in (("start", "min"), ("end", "max"))) + " FROM d GROUP BY 1"))
def _(spark, sf):
    df = ema.phase_bounds(_derived(spark, sf))
    return df.select("customer", *[F.col(c).cast("string").alias(c) for c in df.columns[1:]])


@query("a13_collapse_clinical", with_tables("SELECT for_id, CAST(max(ema_watch) AS INT) AS ema_watch, CAST(arg_min(age, event) FILTER (age IS NOT NULL) AS INT) AS age, CAST(arg_min(gender, event) AS INT) AS gender FROM clinical GROUP BY 1", "clinical"))
def _(spark, sf):
    return ema.collapse_clinical(fx.clinical(spark, sf).select("for_id", "redcap_event_name", "age", "gender", "ema_watch"))


_MODE = "mo AS (SELECT customer, m FROM (SELECT customer, choice_id AS m, count(*) AS c FROM ema GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY customer ORDER BY c DESC, m) = 1) "


@query("a14_mode_per_user", with_tables(_MODE + "SELECT customer, m AS choice_id_mode FROM mo", "ema"))
def _(spark, sf):
    return ema.mode_per_user(fx.ema_long(spark, sf), ["choice_id"])


@query("a15_binary_na_outcome", with_tables(_MODE + "SELECT id, choice_id - m AS diff, CASE WHEN choice_id > m THEN 'Improvement' WHEN choice_id < m THEN 'Deterioration' ELSE 'No Change' END AS outcome, CASE WHEN choice_id > m THEN 1 ELSE 0 END AS na_label FROM ema JOIN mo USING (customer)", "ema"))
def _(spark, sf):
    df = ema.binary_na_outcome(fx.ema_long(spark, sf), ["choice_id"])
    return df.select("id", F.col("choice_id_diff").alias("diff"), F.col("choice_id_outcome").alias("outcome"), (F.col("choice_id_diff") > 0).cast("int").alias("na_label"))


@query("a28_scale_means", _sql("m AS (SELECT customer, assess, avg(TRY_CAST(choice_text AS DOUBLE)) AS a, CAST(avg(k) AS DOUBLE) AS b FROM (SELECT d.*, choice_id AS k FROM d) GROUP BY 1, 2) SELECT customer, assess, 'Anger' AS scale, round(a, 6) AS value FROM m UNION ALL SELECT customer, assess, 'Reappraisal', round(b, 6) FROM m"))
def _(spark, sf):
    df = _derived(spark, sf).withColumnsRenamed({"choice_text": "panas_anger"}).withColumn("er_reappraisal", F.col("choice_id"))
    return rounded(ema.scale_means_by_phase(df))


@query("a37_daily_entry_counts", with_tables("c AS (SELECT customer, CAST(quest_create AS DATE) AS day, count(*) AS n FROM sessions GROUP BY 1, 2) SELECT customer, strftime(day, '%Y-%m-%d') AS day, n, CAST(day - min(day) OVER (PARTITION BY customer) AS INT) AS relative_day FROM c", "sessions"))
def _(spark, sf):
    return ema.daily_entry_counts(fx.sessions(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query("w4_relative_day_index", _sql("SELECT id, CAST(dense_rank() OVER (PARTITION BY customer, assess ORDER BY day) AS INT) AS relative_day FROM d"))
def _(spark, sf):
    return ema.relative_day_index(_derived(spark, sf)).select("id", "relative_day")


@query("w5_absolute_day_index", _sql("x AS (SELECT id, CAST(day - min(day) OVER (PARTITION BY customer, assess) + 1 AS INT) AS absolute_day_index FROM d) SELECT * FROM x WHERE absolute_day_index <= 16"))
def _(spark, sf):
    return ema.absolute_day_index(_derived(spark, sf)).select("id", "absolute_day_index")


@query("w6_questionnaire_counter", _sql("p AS (SELECT customer, assess, unique_day_id, min(quest_create) AS a FROM d GROUP BY 1, 2, 3), c AS (SELECT *, CAST(row_number() OVER (PARTITION BY customer, assess ORDER BY a, unique_day_id) AS INT) AS n FROM p) SELECT id, n AS questionnaire_counter FROM d JOIN c USING (customer, assess, unique_day_id)"))
def _(spark, sf):
    return ema.questionnaire_counter(_derived(spark, sf)).select("id", "questionnaire_counter")


@query("w7_group_sizes", _sql("SELECT id, count(*) OVER (PARTITION BY customer) AS n_data, count(*) OVER (PARTITION BY customer, day) AS n_data_day FROM d"))
def _(spark, sf):
    return ema.group_sizes(_derived(spark, sf), {"n_data": ["customer"], "n_data_day": ["customer", "quest_create_day"]}).select("id", "n_data", "n_data_day")


@query("w8_relative_to_first_day", _sql("SELECT id, strftime(min(day) OVER (PARTITION BY customer), '%Y-%m-%d') AS first_day, CAST(day - min(day) OVER (PARTITION BY customer) AS INT) AS day_offset FROM d"))
def _(spark, sf):
    df = ema.relative_to_first_day(_derived(spark, sf), "quest_create_day")
    return df.select("id", F.col("first_day").cast("string").alias("first_day"), "day_offset")


_WEEKS = "w AS (SELECT e.*, CASE WHEN CAST(quest_create AS DATE) - ema_base_start BETWEEN 0 AND 7 THEN 1 WHEN CAST(quest_create AS DATE) - ema_base_start BETWEEN 8 AND 14 THEN 2 END AS week FROM ema e JOIN roster USING (customer)) "


def _weeks(spark, sf):
    return ema.split_weeks(fx.ema_long(spark, sf).join(fx.roster(spark, sf), "customer"), "ema_base_start", "quest_create")


@query("w10_split_weeks", with_tables(_WEEKS + "SELECT id, week, count(*) OVER (PARTITION BY customer, week) AS n_week FROM w WHERE week IS NOT NULL", "ema", "roster"))
def _(spark, sf):
    return _weeks(spark, sf).select("id", "week", "n_week")


@query("a29_week_means", with_tables(_WEEKS.rstrip() + ", m AS (SELECT customer, week, (avg(choice_id) + avg(id % 10)) / 2 AS m FROM w WHERE week IS NOT NULL GROUP BY 1, 2) SELECT a.customer, round(a.m, 6) AS mean_first, round(b.m, 6) AS mean_second FROM m a JOIN m b USING (customer) WHERE a.week = 1 AND b.week = 2", "ema", "roster"))
def _(spark, sf):
    return rounded(ema.week_means(_weeks(spark, sf).withColumn("other", F.col("id") % 10), ["choice_id", "other"]))


@query("w_ema_blocks", _sql("SELECT customer, customer || unique_day_id AS unique_blocks, strftime(min(quest_create) - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS b0, strftime(min(quest_create), '%Y-%m-%d %H:%M:%S') AS b1 FROM d GROUP BY customer, unique_day_id"))
def _(spark, sf):
    return ema.ema_blocks(_derived(spark, sf)).select("customer", "unique_blocks", stamp("sensor_block_start").alias("b0"), stamp("sensor_block_end").alias("b1"))


# -- reliability -------------------------------------------------------------

_PAIR = "p AS (SELECT a.customer, a.n AS n1, b.n AS n2, a.total AS t1, b.total AS t2 FROM weeks a JOIN weeks b USING (customer) WHERE a.week = 1 AND b.week = 2) "


def _pairs(spark, sf):
    w = fx.weeks(spark, sf)
    return relational.week_pair_join(w.where("week = 1"), w.where("week = 2"))


@query("a30_retest_correlation", with_tables(_PAIR + "SELECT 'n' AS feature, round(corr(ln(n1), ln(n2)), 6) AS r FROM p UNION ALL SELECT 'total', round(corr(ln(t1), ln(t2)), 6) FROM p", "weeks"))
def _(spark, sf):
    return rounded(reliability.retest_correlation(_pairs(spark, sf), ["n", "total"]))


def _icc_sql(a: str, b: str, name: str) -> str:
    return f"""SELECT '{name}' AS feature, round((msr - mse) / (msr + mse + 2 * (msc - mse) / n), 6) AS icc FROM (SELECT n, sr / (n - 1) AS msr, sc AS msc, (st - sr - sc) / (n - 1) AS mse FROM (
        SELECT count(*) AS n, sum(2 * pow(({a} + {b}) / 2 - g, 2)) AS sr, count(*) * (pow(avg({a}) - any_value(g), 2) + pow(avg({b}) - any_value(g), 2)) AS sc, sum(pow({a} - g, 2) + pow({b} - g, 2)) AS st
        FROM p, (SELECT (avg({a}) + avg({b})) / 2 AS g FROM p)))"""


@query("a31_icc2_1", with_tables(_PAIR + _icc_sql("n1", "n2", "n") + " UNION ALL " + _icc_sql("t1", "t2", "total"), "weeks"))
def _(spark, sf):
    return rounded(reliability.icc2_1(_pairs(spark, sf), ["n", "total"]))


# -- situations --------------------------------------------------------------


def _situations(spark, sf):
    """Prompts with situations: four prompts a day and user share an id."""
    e = fx.events(spark, sf)
    return e.select("customer", F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("_"), F.floor(F.hour("ts") / 6).cast("string")).alias("unique_day_id"), F.col("event_type").alias("situation"), "k", "value", "id", (F.length("customer") % 2).alias("diagnosis"))


_SIT = "s AS (SELECT customer, strftime(ts, '%Y%m%d') || '_' || (hour(ts) // 6) AS unique_day_id, event_type AS situation, k, value, id, length(customer) % 2 AS diagnosis FROM ev) "


@query("a26_blau_index", with_tables(_SIT + ", c AS (SELECT customer, situation, count(*) AS n FROM s GROUP BY 1, 2) SELECT customer, round(1 - sum(n * n) / pow(sum(n), 2), 6) AS blau FROM c GROUP BY 1"))
def _(spark, sf):
    return rounded(situations.blau_index(_situations(spark, sf), "situation", ["customer"]))


@query("a32_situation_share", with_tables(_SIT + ", p AS (SELECT diagnosis, count(DISTINCT customer || '|' || unique_day_id) AS n_prompts FROM s GROUP BY 1), c AS (SELECT diagnosis, situation, count(*) AS n FROM s GROUP BY 1, 2) SELECT CAST(diagnosis AS INT) AS diagnosis, situation, n, n_prompts, round(100.0 * n / n_prompts, 6) AS percent FROM c JOIN p USING (diagnosis)"))
def _(spark, sf):
    return rounded(situations.situation_share(_situations(spark, sf), "diagnosis", "situation"))


@query("a33_choice_combinations", with_tables(_SIT + ", c AS (SELECT customer, unique_day_id, string_agg(situation, ',' ORDER BY situation) AS combination FROM s GROUP BY 1, 2) SELECT combination, count(*) AS n FROM c GROUP BY 1"))
def _(spark, sf):
    return situations.choice_combinations(_situations(spark, sf), "situation")


@query("a34_situation_means", with_tables(_SIT + ", o AS (SELECT * FROM s QUALIFY count(*) OVER (PARTITION BY customer, unique_day_id) = 1) SELECT situation, round(avg(k), 6) AS mean_k, round(avg(value), 6) AS mean_value FROM o GROUP BY 1"))
def _(spark, sf):
    return rounded(situations.situation_means(_situations(spark, sf), "situation", ["k", "value"]))


@query("a35_multi_hot", with_tables(_SIT + "SELECT customer, unique_day_id, " + ", ".join(f"max(CASE WHEN situation = '{x}' THEN 1 ELSE 0 END) AS situation_{x}" for x in ("click", "error", "purchase", "signup", "view")) + " FROM s GROUP BY 1, 2"))
def _(spark, sf):
    return situations.multi_hot(_situations(spark, sf), "situation", 9)


@query("a36_trend_line", with_tables("o AS (SELECT customer, min(k) AS k, min(value) AS value FROM ev GROUP BY 1) SELECT round(regr_slope(value, k), 6) AS slope, round(regr_intercept(value, k), 6) AS intercept, CAST(regr_count(value, k) AS BIGINT) AS n FROM o"))
def _(spark, sf):
    return rounded(situations.trend_line(fx.events(spark, sf), "k", "value", ["customer"]))


@query("a38_zero_filled_histogram", with_tables("c AS (SELECT CAST(k * 3 AS BIGINT) AS value, count(*) AS n FROM ev GROUP BY 1) SELECT CAST(g AS BIGINT) AS value, coalesce(n, 0) AS n FROM (SELECT unnest(range((SELECT min(value) FROM c), (SELECT max(value) FROM c) + 1)) AS g) LEFT JOIN c ON c.value = g"))
def _(spark, sf):
    return situations.zero_filled_histogram(fx.events(spark, sf).withColumn("x", F.col("k") * 3), "x")


# -- models ------------------------------------------------------------------

_TRAIN = "t AS (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY ts) AS i, count(*) OVER (PARTITION BY customer) AS c FROM ev) "


def _timed(spark, sf):
    return fx.events(spark, sf).withColumnRenamed("ts", "sensor_block_end")


def _split(spark, sf):
    df = modelling.inner_time_split(_timed(spark, sf))
    return df.where("is_train"), df.where("not is_train")


@query("l1_outer_user_split", with_tables("""u AS (SELECT DISTINCT customer, length(customer) AS s FROM ev), c AS (SELECT s, count(*) AS c, count(*) * 0.2::DOUBLE AS x FROM u GROUP BY 1),
    q AS (SELECT *, floor(x) + CASE WHEN row_number() OVER (ORDER BY floor(x) - x, CAST(s AS VARCHAR)) <= floor((SELECT sum(c) FROM c) * 0.2::DOUBLE) - (SELECT sum(floor(x)) FROM c) THEN 1 ELSE 0 END AS h FROM c)
    SELECT 'holdout' AS part, CAST(s AS INT) AS stratum, CAST(h AS BIGINT) AS n, CAST(h AS BIGINT) AS whole FROM q WHERE h > 0 UNION ALL SELECT 'rest', CAST(s AS INT), CAST(c - h AS BIGINT), CAST(c - h AS BIGINT) FROM q WHERE c > h"""))  # fmt: skip
def _(spark, sf):
    """Users of each stratum in both parts, and those of them whose rows are all there."""
    df = _timed(spark, sf).withColumn("s", F.length("customer"))
    rest, holdout = modelling.outer_user_split(df, 0.2, "s")
    all_rows = df.groupBy("customer").agg(F.count("*").alias("all"))
    told = lambda part, name: part.groupBy("customer", "s").agg(F.count("*").alias("own")).join(all_rows, "customer").groupBy(F.lit(name).alias("part"), F.col("s").alias("stratum")).agg(F.count("*").alias("n"), F.count_if(F.col("own") == F.col("all")).alias("whole"))
    return told(rest, "rest").unionByName(told(holdout, "holdout"))


@query("l2_inner_time_split", with_tables(_TRAIN + "SELECT id, i <= floor(c * 0.8) AS is_train FROM t"))
def _(spark, sf):
    return modelling.inner_time_split(_timed(spark, sf)).select("id", "is_train")


@query("l3_forward_chaining_folds", with_tables("SELECT id, CAST(CASE WHEN count(*) OVER (PARTITION BY customer) < 5 THEN 0 ELSE ntile(5) OVER (PARTITION BY customer ORDER BY ts) - 1 END AS INT) AS chunk FROM ev"))
def _(spark, sf):
    return modelling.forward_chaining_folds(_timed(spark, sf)).select("id", "chunk")


@query("l19_time_series_folds", with_tables("q AS (SELECT " + ", ".join(f"quantile_cont(epoch_us(ts), {i}/6.0) AS e{i}" for i in range(1, 6)) + " FROM ev) SELECT id, " + " + ".join(f"CASE WHEN epoch_us(ts) > e{i} THEN 1 ELSE 0 END" for i in range(1, 6)) + " AS chunk FROM ev, q"))
def _(spark, sf):
    return modelling.time_series_folds(_timed(spark, sf)).select("id", "chunk")


@query("l5_impute", with_tables("x AS (SELECT id, CASE WHEN id % 4 <> 0 THEN value END AS v FROM ev) SELECT id, round(coalesce(v, (SELECT avg(v) FROM x)), 6) AS v FROM x"))
def _(spark, sf):
    df = modelling.sentinel_to_null(fx.events(spark, sf).withColumn("v", F.when(F.col("id") % 4 != 0, F.col("value")).otherwise(-1.0)), ["v"])
    return rounded(modelling.impute(df, ["v"]).transform(df).select("id", "v"))


@query("l6_one_hot", with_tables("SELECT id, " + ", ".join(f"CASE WHEN event_type = '{x}' THEN 1.0 ELSE 0.0 END::DOUBLE AS \"event_type={x}\"" for x in ("click", "view")) + " FROM ev"))
def _(spark, sf):
    df, names = modelling.one_hot(fx.events(spark, sf), {"event_type": ["click", "view"]})
    return df.select("id", *[F.col(f"`{n}`") for n in names])


@query("l6_preprocess", with_tables(_TRAIN.rstrip() + """, r AS (SELECT id, i <= floor(c * 0.8) AS train, event_type, nullif(CAST(CASE WHEN k % 10 = 0 THEN -1 ELSE value END AS DOUBLE), -1) AS v, CAST(k AS DOUBLE) AS k FROM t),
    m AS (SELECT *, ln(1 + greatest(coalesce(v, avg(v) FILTER (train) OVER ()), -0.999)) AS lv FROM r),
    s AS (SELECT *, min(lv) FILTER (train) OVER () AS v0, max(lv) FILTER (train) OVER () AS v1, min(k) FILTER (train) OVER () AS k0, max(k) FILTER (train) OVER () AS k1 FROM m)
    SELECT id, round((lv - v0) / (v1 - v0), 5) AS value, round((k - k0) / (k1 - k0), 5) AS k, CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END::DOUBLE AS click, CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END::DOUBLE AS view FROM s WHERE NOT train"""))  # fmt: skip
def _(spark, sf):
    """Gaps marked by -1, a skewed and a plain number, a constant one, which goes, and flags."""
    from pyspark.ml.functions import vector_to_array

    gaps = lambda df: df.withColumns({"value": F.when(F.col("k") % 10 == 0, -1.0).otherwise(F.col("value")), "same": F.lit(3.0)})
    train, test = map(gaps, _split(spark, sf))
    _, out = modelling.preprocess(train, [test], ["value"], ["k", "same"], [], {"event_type": ["click", "view"]})
    vector = vector_to_array("features")
    return out.select("id", *[F.round(F.get(vector, F.lit(i)), 5).alias(n) for i, n in enumerate(("value", "k", "click", "view"))])


@query("l7_intercepts", with_tables(_TRAIN.rstrip() + ", tr AS (SELECT * FROM t WHERE i <= floor(c * 0.8)), m AS (SELECT customer, avg(value) AS m FROM tr GROUP BY 1) SELECT id, round((SELECT avg(value) FROM tr), 6) AS overall, round(coalesce(m, (SELECT avg(value) FROM tr)), 6) AS own FROM t LEFT JOIN m USING (customer) WHERE NOT i <= floor(c * 0.8)"))
def _(spark, sf):
    train, test = _split(spark, sf)
    both = modelling.per_user_intercept(train, modelling.global_intercept(train, test, "value").withColumnRenamed("prediction", "overall"), "value")
    return rounded(both.select("id", "overall", F.col("prediction").alias("own")))


@query("l8_per_user_label_scale", with_tables(_TRAIN.rstrip() + ", m AS (SELECT customer, avg(value) AS m, stddev_samp(value) AS s FROM t WHERE i <= floor(c * 0.8) GROUP BY 1) SELECT id, round((value - coalesce(m, 0)) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) AS y_scaled FROM t LEFT JOIN m USING (customer) WHERE NOT i <= floor(c * 0.8)"))
def _(spark, sf):
    train, test = _split(spark, sf)
    return rounded(modelling.per_user_label_scale(train, test, "value").select("id", "y_scaled"))


@query("l9_per_user_feature_scale", with_tables("SELECT id, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 6) AS value FROM ev WINDOW w AS (PARTITION BY customer)"))
def _(spark, sf):
    return rounded(modelling.per_user_feature_scale(fx.events(spark, sf), ["value"]).select("id", "value"))


@query("l10_encode_users", with_tables("f AS (SELECT customer, min(CASE WHEN ts < TIMESTAMP '2024-01-03' THEN ts END) AS a, min(ts) AS b FROM ev GROUP BY 1) SELECT customer, CAST(row_number() OVER (ORDER BY CASE WHEN a IS NULL THEN 1 ELSE 0 END, coalesce(a, b), customer) - 1 AS INT) AS user_index FROM f"))
def _(spark, sf):
    e = _timed(spark, sf)
    early = F.col("sensor_block_end") < F.lit("2024-01-03").cast("timestamp")
    return modelling.encode_users(e.where(early), e.where(~early))


@query("l14_regression_metrics", with_tables("SELECT customer, count(*) AS n, round(avg(abs(value - k)), 6) AS mae, round(sqrt(avg(pow(value - k, 2))), 6) AS rmse, round(CASE WHEN count(*) > 1 THEN 1 - sum(pow(value - k, 2)) / (var_pop(value) * count(*)) END, 4) AS r2 FROM ev GROUP BY 1"))
def _(spark, sf):
    df = modelling.regression_metrics(fx.events(spark, sf), "value", "k", ["customer"])
    return rounded(df.withColumn("r2", F.round("r2", 4)))


@query("l15_holdout_baseline", with_tables(_TRAIN + "SELECT count(*) AS n, round(avg(abs(value - k)), 6) AS mae, round(sqrt(avg(pow(value - k, 2))), 6) AS rmse, round(1 - sum(pow(value - k, 2)) / (var_pop(value) * count(*)), 5) AS r2 FROM t WHERE c >= 5 AND i > c - floor(c * 0.2)"))
def _(spark, sf):
    df = modelling.holdout_baseline(_timed(spark, sf), "value", "k")
    return rounded(df.withColumn("r2", F.round("r2", 5)))


@query("l16_holdout_adaptation", with_tables(_TRAIN.rstrip() + ", m AS (SELECT customer, avg(value) AS p FROM t WHERE i <= floor(c * 0.8) GROUP BY 1) SELECT customer, count(*) AS n, round(avg(abs(value - p)), 6) AS mae, round(sqrt(avg(pow(value - p, 2))), 6) AS rmse, round(CASE WHEN count(*) > 1 AND var_pop(value) * count(*) > 1e-12 THEN 1 - sum(pow(value - p, 2)) / (var_pop(value) * count(*)) END, 4) AS r2 FROM t JOIN m USING (customer) WHERE NOT i <= floor(c * 0.8) GROUP BY 1"))
def _(spark, sf):
    df = modelling.holdout_adaptation(_timed(spark, sf), "value")
    return rounded(df.withColumn("r2", F.round("r2", 4)))


def _vectors(spark, sf):
    """Train and test vectors; labels are taken before features are scaled."""
    labelled = [df.withColumns({"y": F.col("value") + F.col("k"), "label": (F.col("value") > 30).cast("double")}) for df in _split(spark, sf)]
    return modelling.preprocess(labelled[0], labelled[1:], ["value"], ["k"], [], {"event_type": ["click", "view", "error"]})


_FOLDS = "f AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY customer) < 4 THEN 0 ELSE ntile(4) OVER (PARTITION BY customer ORDER BY ts) - 1 END AS chunk, value + k AS y FROM ev)"
_LINES = """, n AS (SELECT * FROM (VALUES (1), (2), (3), (4)) v(fold)),
    w AS (SELECT fold, regr_slope(y, k) AS b1, regr_intercept(y, k) AS a1, sum(y * k) / sum(k * k) AS b0 FROM n JOIN f ON chunk < fold GROUP BY 1),
    l AS (SELECT fold, 0 AS parameters, a1 AS a, b1 AS b FROM w UNION ALL SELECT fold, 1, 0.0, b0 FROM w),
    e AS (SELECT l.fold, parameters, count(*) AS n, avg(abs(y - a - b * k)) AS mae, sqrt(avg(pow(y - a - b * k, 2))) AS rmse FROM l JOIN f ON f.chunk = l.fold GROUP BY 1, 2)"""


@query("l11_l13_linear_grid_search", with_tables(_FOLDS + _LINES + """,
    best AS (SELECT parameters FROM e GROUP BY 1 ORDER BY avg(mae), parameters LIMIT 1)
    SELECT CAST(fold AS INT) AS fold, CAST(parameters AS INT) AS parameters, round(a, 5) AS intercept, round(b, 5) AS slope, n, round(mae, 5) AS mae, round(rmse, 5) AS rmse, parameters = (SELECT parameters FROM best) AS best FROM l LEFT JOIN e USING (fold, parameters)"""))  # fmt: skip
def _(spark, sf):
    """All folds and both parameter sets from two scans; fold 4 is the fit on all rows."""
    from pyspark.ml.feature import VectorAssembler

    rows = modelling.forward_chaining_folds(_timed(spark, sf).withColumn("y", F.col("value") + F.col("k")), 4)
    rows = VectorAssembler(inputCols=["k"], outputCol="features").transform(rows)
    models, whole = linear.fold_models(rows, "y", 4, modelling.LINEAR_GRID)
    _, best, _scores = linear.linear_grid_search(rows, 4, modelling.LINEAR_GRID, "y")
    told = [(f, p, float(m.intercept), float(m.coefficients[0]), best == modelling.LINEAR_GRID[p]) for (f, p), m in [*models.items(), *(((4, p), m) for p, m in enumerate(whole))]]
    table = spark.createDataFrame(told, "fold int, parameters int, intercept double, slope double, best boolean")
    found = table.join(linear.fold_errors(rows, "y", models), ["fold", "parameters"], "left")
    return found.select("fold", "parameters", "n", "best", *[F.round(c, 5).alias(c) for c in ("intercept", "slope", "mae", "rmse")])


@query("l12_forest")
def _(spark, sf):
    train, test = _vectors(spark, sf)
    fitted = modelling.fit_forest(train, "y", 5, 4)
    return rounded(modelling.regression_metrics(fitted.transform(test), "y"))


@query("l17_mixed_forest")
def _(spark, sf):
    train, test = _vectors(spark, sf)
    fitted = modelling.fit_mixed_forest(train, "y", 2, numTrees=5, maxDepth=3)
    return rounded(modelling.regression_metrics(modelling.predict_mixed_forest(fitted, test), "y"))


@query("l17_shrunk_intercepts", with_tables("""p AS (SELECT customer, count(*) AS n, avg(value - k) AS m, sum(pow(value - k, 2)) AS ss FROM ev GROUP BY 1),
    b AS (SELECT *, 50.0 / (50.0 + 900.0 / n) * m AS b, 50.0 * (1 - 50.0 / (50.0 + 900.0 / n)) AS v FROM p),
    w AS (SELECT sum(ss - 2 * b * n * m + n * (b * b + v)) / sum(n) AS sigma2, avg(b * b + v) AS tau2 FROM b)
    SELECT customer, n, round(b, 6) AS b, round(v, 6) AS v, round(sigma2, 4) AS sigma2, round(tau2, 4) AS tau2 FROM b, w"""))  # fmt: skip
def _(spark, sf):
    """One round of the random intercepts, with the variances that follow."""
    residuals = fx.events(spark, sf).withColumn("r", F.col("value") - F.col("k"))
    users = modelling.shrunk_intercepts(residuals, "r", 900.0, 50.0)
    after = modelling.intercept_variances(users)
    joined = users.crossJoin(F.broadcast(after))  # one row
    return joined.select("customer", "n", *[F.round(c, d).alias(c) for c, d in (("b", 6), ("v", 6), ("sigma2", 4), ("tau2", 4))])


@query("l18_classification_metrics", with_tables("""s AS (SELECT CASE WHEN value > 30 THEN 1 ELSE 0 END AS y, CAST(k // 5 AS DOUBLE) AS score, CASE WHEN k > 60 THEN 1 ELSE 0 END AS q FROM ev),
    r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS mid FROM s),
    a AS (SELECT (sum(CASE WHEN y = 1 THEN mid END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auc FROM r),
    f AS (SELECT c, count_if(y = c) AS own, 2.0 * count_if(y = c AND q = c) / (count_if(y = c) + count_if(q = c)) AS f1 FROM s, (VALUES (0), (1)) v(c) GROUP BY 1)
    SELECT (SELECT count(*) FROM s) AS n, round((SELECT avg(CASE WHEN y = q THEN 1.0 ELSE 0.0 END) FROM s), 6) AS accuracy, round(sum(f1 * own) / sum(own), 6) AS f1, round((SELECT auc FROM a), 6) AS auc FROM f"""))  # fmt: skip
def _(spark, sf):
    e = fx.events(spark, sf)
    given = e.select((F.col("value") > 30).cast("int").alias("y"), F.floor(F.col("k") / 5).alias("score"), (F.col("k") > 60).cast("int").alias("q"))
    return rounded(scores.classification_metrics(given, "y", "q", "score"))


@query("l18_affect_classifier")
def _(spark, sf):
    train, test = _vectors(spark, sf)
    model, metrics = modelling.fit_affect_classifier(train, "label", numTrees=5, maxDepth=3)
    told = model.transform(test).groupBy("prediction").agg(F.count("*").alias("n"))
    return told.select("prediction", "n", *[F.lit(float(metrics[m])).alias(m) for m in ("accuracy", "f1", "auc")])
