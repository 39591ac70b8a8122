"""Edge cases of the study operators, and properties against plain Python."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as P
from pulsegrid.operators import ema, gps, intervals, modelling, quality, relational, reliability, sensors

T0 = datetime.datetime(2024, 1, 5, 12)


def at(minutes: float) -> datetime.datetime:
    return T0 + datetime.timedelta(minutes=minutes)


def records(spark, rows, value="longValue long"):
    return spark.createDataFrame([(c, at(a), None if b is None else at(b), v) for c, a, b, v in rows], f"customer string, startTimestamp timestamp, endTimestamp timestamp, {value}")


def blocks(spark, rows):
    return spark.createDataFrame([(c, n, at(a), at(b)) for c, n, a, b in rows], "customer string, unique_blocks string, sensor_block_start timestamp, sensor_block_end timestamp")


def test_touching_and_empty_intervals(spark):
    s = records(spark, [("u", -30, 0, 1), ("u", 120, 130, 2), ("u", 60, 60, 3), ("u", 121, 125, 4), ("v", 0, 60, 5), ("u", 10, None, 6), ("u", 50, 40, 7)])
    got = intervals.overlap_join(s, blocks(spark, [("u", "b", 0, 120)])).select("longValue", "overlap_seconds").collect()
    assert sorted(map(tuple, got)) == [(1, 0.0), (2, 0.0), (3, 0.0)]


@pytest.mark.parametrize("seconds", [600, 7200])
def test_bucketed_join_is_the_naive_join(spark, seconds):
    rng = random.Random(5)
    rec = [(rng.choice("uvw"), a := rng.randint(-3000, 3000), a + rng.choice([0, 5, 90, 4000]), i) for i in range(300)]
    blk = [(rng.choice("uvw"), f"b{i}", a := rng.randint(-3000, 3000), a + rng.choice([0, 120, 1500])) for i in range(60)]
    got = intervals.overlap_join(records(spark, rec), blocks(spark, blk), seconds=seconds).select("longValue", "unique_blocks").collect()
    want = [(i, n) for c, a, b, i in rec for d, n, x, y in blk if c == d and a <= y and b >= x]
    assert sorted(map(tuple, got)) == sorted(want)


def test_heart_rate_blocks(spark):
    s = records(spark, [("u", 0, 30, 50), ("u", 30, 60, 80), ("u", 100, 200, 120)])
    b = blocks(spark, [("u", "full", 0, 120), ("u", "none", 500, 620), ("x", "other", 0, 120)])
    got = {r.unique_blocks: r for r in sensors.map_heart_rate_to_ema(b, s).collect()}
    full = got["full"]
    assert (full.hr_min, full.hr_max, full.hr_zone_resting, full.hr_zone_moderate, full.hr_zone_vigorous) == (50, 120, 30, 30, 20)
    assert full.hr_std == pytest.approx(np.std([50, 80, 120]))
    assert got["none"].hr_mean == got["other"].hr_mean == -1
    assert sensors.map_heart_rate_to_ema(b, s, compute_stats=False).columns == ["customer", "unique_blocks", "hr_mean"]


def test_block_minutes_do_not_exceed_the_block(spark, sf):
    from pulsegrid.jobs import registry

    rows = registry.QUERIES["a22_gps_blocks"](spark, sf).where("n_GPS > 0").collect()
    assert rows and all(r.time_in_transition_minutes + r.time_stationary_minutes <= 24 * 60 + 1e-6 for r in rows)


def test_steps_truncate_and_clean(spark):
    s = records(spark, [("u", -10, 10, 101.0), ("u", 0, 0, 5.0), ("u", 0, 1, 500.0), ("u", 0, 10, -3.0)], "doubleValue double")
    clean = sensors.clean_step_data(s)
    assert clean.count() == 1
    assert sensors.map_steps_to_ema(blocks(spark, [("u", "b", 0, 60)]), clean).first().n_steps == 50  # 50.5 cut


def track(spark, rows):
    return spark.createDataFrame([(c, at(m), lat, lon) for c, m, lat, lon in rows], "customer string, startTimestamp timestamp, Latitude double, Longitude double")


def test_speeds_mix_forward_distance_and_backward_time(spark):
    g = track(spark, [("u", 0, 52.5, 13.4), ("u", 10, 52.501, 13.4), ("u", 10, 52.501, 13.4), ("v", 0, 1.0, 1.0)])
    rows = gps.calculate_distances_and_speeds(g).orderBy("customer", "startTimestamp", F.desc("distance")).collect()
    assert rows[0].time_diff == 0 and rows[0].speed is None and rows[0].distance == pytest.approx(111.19, abs=0.1)
    assert rows[-1].customer == "v" and rows[-1].distance == 0 and rows[-1].speed is None


def brute_dbscan(lat, lon, eps, k):
    n = len(lat)
    near = [[j for j in range(n) if gps._metres(lat[i], lon[i], lat[j], lon[j]) <= eps] for i in range(n)]
    core = [len(x) >= k for x in near]
    labels, number = [-1] * n, 0
    for i in range(n):
        if core[i] and labels[i] == -1:
            todo, labels[i] = [i], number
            while todo:
                for j in near[todo.pop()]:
                    if labels[j] == -1:
                        labels[j] = number
                        if core[j]:
                            todo.append(j)
            number += 1
    return labels, core


def test_density_labels_match_the_definition():
    rng = np.random.default_rng(3)
    for _ in range(5):
        lat = 52.5 + rng.normal(0, 0.003, 120)
        lon = 13.4 + rng.normal(0, 0.004, 120)
        lat[:20], lon[:20] = lat[0], lon[0]
        for k in (2, 4, 9):
            assert gps.density_labels(lat, lon, 100, k).tolist() == brute_dbscan(lat, lon, 100, k)[0]
    for lat0, lon0, wide in ((0.0, 0.0, 0.004), (-52.5, 179.999, 0.006), (88.9, -120.0, 0.3)):  # equator, date line, near a pole
        lat = lat0 + rng.normal(0, 0.003, 100)
        lon = (lon0 + rng.normal(0, wide, 100) + 180) % 360 - 180
        assert gps.density_labels(lat, lon, 100, 4).tolist() == brute_dbscan(lat, lon, 100, 4)[0]
    assert (gps.density_labels(np.array([1.0, 2.0]), np.array([1.0, 2.0]), 100, 2) == -1).all()


def test_density_labels_of_many_close_points():
    rng = np.random.default_rng(4)
    lat, lon = 52.5 + rng.normal(0, 0.0003, 100_000), 13.4 + rng.normal(0, 0.0003, 100_000)
    lat[50_000:] += 0.02
    labels = gps.density_labels(lat, lon, 100, 10)
    assert (labels[:50_000] == 0).all() and (labels[50_000:] == 1).all()


def test_share_of_points_for_seldom_senders(spark):
    g = track(spark, [("u", i, 52.5, 13.4) for i in range(4)] + [("u", 9, 53.5, 13.4)])
    assert {r.cluster for r in gps.dbscan(g, min_data_points=5).collect()} == {-1}
    assert sorted(r.cluster for r in gps.dbscan(g, min_data_points=5, min_share=0.03).collect()) == [-1, 0, 0, 0, 0]


def test_home_ties_and_fallback(spark):
    night = lambda d, h: (d * 24 + h) * 60  # noqa: E731  minutes after noon: h 10 is 22 o'clock
    rows = [("u", night(d, 10), c) for d in range(4) for c in (1, 2)] + [("v", night(0, 1), 5), ("v", night(0, 2), 5), ("v", night(0, 10), 3), ("n", 0, -1)]
    g = spark.createDataFrame([(c, at(m), k) for c, m, k in rows], "customer string, startTimestamp timestamp, cluster int")
    home = {r.customer: r.home for r in gps.find_home_cluster(g, 4, 0.5).collect()}
    assert home == {"u": 1, "v": 5, "n": None}
    assert {r.customer: r.home for r in gps.find_home_cluster(g, 4, 0.6).collect()}["u"] == 1  # share too small: largest, tie smallest
    assert {r.customer: r.home for r in gps.find_home_cluster(g, 4, 0.5, strict=True).collect()} == {"u": None, "v": None, "n": None}
    for limits in ((4, 0.5), (4, 0.6), (4, 0.5, True), (4, 0.5, False, True)):
        want = {r.customer: r.home for r in gps.find_home_cluster(g, *limits).collect()}
        assert {r.customer: r.home for r in gps.with_home(g, *limits).collect()} == want
    flags = gps.determine_if_at_home(g.join(gps.find_home_cluster(g, 4, 0.5), "customer")).where("customer = 'n'").first()
    assert flags.at_home == -1


def test_metrics_of_odd_groups(spark):
    g = track(spark, [("one", 0, 1.0, 1.0), ("noise", 0, 1.0, 1.0), ("noise", 5, 1.1, 1.0), ("two", 0, 1.0, 1.0), ("two", 60, 1.0, 2.0)])
    g = g.withColumn("cluster", F.when(F.col("customer") == "noise", -1).otherwise(0)).withColumn("home", F.lit(0))
    rows = {r.customer: r for r in gps.calculate_metrics(g, ["customer"]).collect()}
    assert rows["one"].entropy is None and rows["one"].num_unique_clusters == 1
    assert rows["noise"].entropy is None and rows["noise"].total_distance == 0 and rows["noise"].num_total_clusters == 0
    assert rows["two"].entropy == pytest.approx(-1e-10 * math.log(1e-10), rel=1e-3) and rows["two"].percentage_time_at_home == 100
    entropy = {r.customer: r.raw_entropy for r in gps.raw_location_entropy(g, ["customer"]).collect()}
    assert entropy["one"] == pytest.approx(0) and entropy["two"] == pytest.approx(math.log(2))


def test_raw_entropy_of_points_on_the_edges_of_bins(spark):
    steps = [0, 1, 5, 7, 10, 3, 9]  # tenths of the range: each but the first two has a bin of its own
    g = track(spark, [("u", i, 52.5 + 0.06 + 0.00001 * k, 13.4) for i, k in enumerate(steps)])
    entropy = gps.raw_location_entropy(g, ["customer"]).first().raw_entropy
    assert entropy == pytest.approx(math.log(7) - 2 * math.log(2) / 7)


def test_few_points_get_the_labels_of_the_grid_without_one(monkeypatch):
    rng = np.random.default_rng(3)
    for _ in range(60):
        n, eps, least = int(rng.integers(1, 120)), float(rng.choice([20, 60, 100])), int(rng.integers(1, 6))
        c = rng.integers(0, 12, n)
        lat, lon = 52.5 + 0.0006 * (c % 4) + 1e-5 * rng.integers(0, 40, n), 13.4 + 0.0009 * (c // 4) + 1e-5 * rng.integers(0, 40, n)
        with monkeypatch.context() as m:
            m.setattr(gps, "FEW", 0)
            want = gps.density_labels(lat, lon, eps, least)
        with monkeypatch.context() as m:
            m.setattr(gps, "_Grid", None)
            assert (gps.density_labels(lat, lon, eps, least) == want).all()


def test_adaptive_kmeans_stays_within_the_distance(spark):
    g = track(spark, [("u", i, 52.5 + 0.02 * (i % 3), 13.4) for i in range(30)])
    out = gps.adaptive_kmeans(g, 500)
    assert out.select("cluster").distinct().count() == 3
    with pytest.raises(ValueError):
        gps.extract_home(g, eps_m=0)


def test_adaptive_kmeans_hands_groups_over_as_arrow(spark):
    g = track(spark, [("u", 9, 52.5, 13.4), ("u", 1, 52.6, 13.4), ("u", 2, 52.5, 13.4), ("v", 0, None, 13.4), ("w", 0, 52.5, 13.4)])
    kinds = []
    with pytest.MonkeyPatch.context() as m:
        grouped = type(g.groupBy("customer"))
        m.setattr(grouped, "applyInPandas", lambda *_: kinds.append("pandas"))
        found = gps.adaptive_kmeans(g, 500)
    assert not kinds and sorted((r.customer, r.Latitude or 0, r.cluster) for r in found.collect()) == [("u", 52.5, 1), ("u", 52.5, 1), ("u", 52.6, 0), ("v", 0, -1), ("w", 52.5, 0)]


def plain_kmeans(x, w, d_max, max_k):
    """The same growth without bounds."""
    c = np.average(x, axis=0, weights=w)[None]
    own = np.zeros(len(x), int)
    for k in range(1, max_k + 1):
        far = gps._metres(x[:, 0], x[:, 1], c[own, 0], c[own, 1])
        if far.max() <= d_max or k == min(max_k, len(x)):
            return own
        c = np.vstack([c, x[far.argmax()]])
        own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        for _ in range(50):
            new = np.array([np.average(x[own == i], axis=0, weights=w[own == i]) if (own == i).any() else c[i] for i in range(k + 1)])
            moved, c = np.abs(new - c).max(), new
            own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            if moved < 1e-12:
                break


def test_growing_kmeans_equals_the_plain_one():
    rng = np.random.default_rng(1)
    for d_max, max_k in ((500, 50), (1500, 50), (100, 7)):
        x = rng.normal(0, 0.02, (300, 2)) + [52.5, 13.4]
        w = rng.integers(1, 40, 300).astype(float)
        same = lambda a: np.unique(a, return_index=True)[1][np.unique(a, return_inverse=True)[1]]
        assert (same(gps.growing_kmeans(x, w, d_max, max_k)) == same(plain_kmeans(x, w, d_max, max_k))).all()


def test_adaptive_kmeans_counts_visits_and_passes_over_gaps(spark):
    rows = [("u", i, 52.5, 13.4) for i in range(99)] + [("u", 99, 52.508, 13.4), ("u", 100, None, 13.4), ("u", 101, float("nan"), 13.4), ("v", 0, None, None)]
    rows += [("w", 0, 52.5, 13.4), ("w", 1, 52.508, 13.4)]
    out = {(r.customer, r.startTimestamp): r.cluster for r in gps.adaptive_kmeans(track(spark, rows), 500).collect()}
    assert len(out) == 105 and [out["u", at(m)] for m in (0, 50, 99, 100, 101)] == [0, 0, 1, -1, -1] and out["v", at(0)] == -1
    assert out["w", at(0)] == out["w", at(1)] == 0  # half-way, 445 m


def test_offsets_and_dates(spark):
    df = spark.createDataFrame([(T0, T0, 60), (T0, T0, None)], "startTimestamp timestamp, endTimestamp timestamp, timezoneOffset long")
    shift = lambda policy: [r[0] for r in P.apply_tz_offset(df, "min", policy).select("startTimestamp").collect()]
    assert shift("zero") == [at(60), T0] and shift("null") == [at(60), None] and shift("keep") == [at(60), T0]
    with pytest.raises(ValueError):
        P.apply_tz_offset(df, "min", "other")
    texts = spark.createDataFrame([("Mo, 01.02.2024",), ("1.2.2024",), ("nonsense",), (None,)], "d string")
    assert [r[0] and r[0].isoformat() for r in texts.select(P.parse_dayfirst("d")).collect()] == ["2024-02-01", "2024-02-01", None, None]


def test_calendar_edges(spark):
    days = [datetime.datetime(2024, 2, 29, 4, 59), datetime.datetime(2024, 3, 1, 5), datetime.datetime(2024, 11, 30, 20, 59), datetime.datetime(2024, 12, 1, 21), None]
    df = P.calendar_features(spark.createDataFrame([(d,) for d in days], "t timestamp"), "t")
    assert [(r.season, r.time_of_day) for r in df.collect()] == [("Winter", "Night"), ("Spring", "Early Morning"), ("Fall", "Evening"), ("Winter", "Night"), (None, None)]


def test_ids_without_a_number(spark):
    df = spark.createDataFrame([("Abend",), ("Q 12 x 3",)], "n string").select(P.unique_day_id(F.lit(T0), P.questionnaire_number("n")).alias("i"))
    assert [r.i for r in df.collect()] == ["20240105_unknown", "20240105_12.0"]


def test_roster_join_keeps_people_without_data(spark):
    s = spark.createDataFrame([("a", 1), ("z", 2)], "customer string, v int")
    r = spark.createDataFrame([("a", "x"), ("b", "y")], "customer string, status string")
    got = {tuple(x) for x in relational.attach_roster(s, r).select("customer", "v", "status").collect()}
    assert got == {("a", 1, "x"), ("b", None, "y")}


def test_store_keeps_only_later_rows(spark):
    old = spark.createDataFrame([(1, at(0)), (2, at(5))], "i int, startTimestamp timestamp")
    new = spark.createDataFrame([(3, at(5)), (4, at(6))], "i int, startTimestamp timestamp")
    assert sorted(r.i for r in relational.incremental_append(old, new).collect()) == [1, 2, 4]
    assert sorted(r.i for r in relational.incremental_append(old.limit(0), new).collect()) == [3, 4]


def test_modes_and_gate(spark):
    df = spark.createDataFrame([("u", 2), ("u", 1), ("u", None)], "customer string, x int")
    assert [r.x_outcome for r in ema.binary_na_outcome(df, ["x"]).orderBy("x").collect()] == ["No Change", "No Change", "Improvement"]


def test_missing_names(spark):
    row = {"n_GPS": -1.0, "n_steps": 625.0, "hr_mean": -1.0, "at_home_minute": -1.0} | {c: -1.0 for c in quality.ACTIVITY}
    df = spark.createDataFrame([tuple(row.values())], list(row))
    out = quality.classify_missing_hr(quality.classify_missing_pa(quality.classify_missing_steps(quality.classify_missing_gps(df)))).first()
    assert (out.missing_GPS, out.missing_steps, out.missing_pa, out.missing_hr) == ("Steps<=625", "not_missing", "pa_zero", "hr_missing")


def test_icc_of_few_and_of_equal_pairs(spark):
    few = spark.createDataFrame([(float(i), float(i)) for i in range(4)], "x_first double, x_second double")
    assert reliability.icc2_1(few, ["x"]).first().icc is None
    many = spark.createDataFrame([(float(i), float(i)) for i in range(8)], "x_first double, x_second double")
    assert reliability.icc2_1(many, ["x"]).first().icc == pytest.approx(1)


def model_rows(spark, users=20, per=12):
    rng = random.Random(2)
    rows = [(f"u{u:02d}", at(60 * i), float(i), rng.random() + u, u % 2) for u in range(users) for i in range(per if u else 3)]
    return spark.createDataFrame(rows, "customer string, sensor_block_end timestamp, x double, y double, s int")


def test_user_split_is_exact_and_disjoint(spark):
    df = model_rows(spark)
    rest, out = modelling.outer_user_split(df, 0.25, "s")
    a, b = ({r[0] for r in x.select("customer").distinct().collect()} for x in (rest, out))
    assert len(b) == 5 and not a & b and len(a | b) == 20
    with pytest.raises(ValueError):
        modelling.outer_user_split(df, 0.05)


def test_folds_of_short_users(spark):
    rows = modelling.forward_chaining_folds(model_rows(spark), 5).collect()
    assert {r.chunk for r in rows if r.customer == "u00"} == {0}
    sizes = [sum(r.customer == "u01" and r.chunk == i for r in rows) for i in range(5)]
    assert sizes == [3, 3, 2, 2, 2]


def test_unseen_users(spark):
    df = model_rows(spark)
    train, test = df.where("customer != 'u05'"), df.where("customer = 'u05'")
    mean = train.agg(F.avg("y")).first()[0]
    assert modelling.per_user_intercept(train, test, "y").first().prediction == pytest.approx(mean)
    scaled = modelling.per_user_label_scale(train, test, "y").first()
    assert scaled.y_scaled == scaled.y
    train, test = modelling.preprocess(train, [test], ["x"], [], [], {})
    fitted = modelling.fit_mixed_forest(train, "y", 2, numTrees=3, maxDepth=2)
    plain, mixed = fitted[0].transform(test).first().prediction, modelling.predict_mixed_forest(fitted, test).first().prediction
    assert plain == pytest.approx(mixed)
    known = modelling.regression_metrics(modelling.predict_mixed_forest(fitted, train), "y").first().mae
    assert known < modelling.regression_metrics(fitted[0].transform(train), "y").first().mae


def test_workload_c(spark):
    from pulsegrid.jobs.pipelines import evaluate

    said = evaluate(model_rows(spark), "y", ["x"], n_folds=3, ratio=0.2)
    assert said["best"] in modelling.LINEAR_GRID and said["inner"]["n"] > 0 and said["holdout"]["mae"] >= 0


def test_feature_lists():
    own = modelling.select_features(static=False)
    assert own[0] == "customer" and "age" not in own and "hr_mean" in own


def test_time_folds_over_all_users_are_exact_quantiles(spark):
    rng = random.Random(6)
    minutes = [rng.choice([0, 1, 59, 60, 61, 600, 3000, rng.randint(0, 9000)]) for _ in range(101)]
    df = spark.createDataFrame([(at(m),) for m in minutes] + [(None,)], "sensor_block_end timestamp")
    got = [(r.sensor_block_end, r.chunk) for r in modelling.time_series_folds(df, 4).collect()]
    edges = np.quantile(minutes, [0.2, 0.4, 0.6, 0.8])
    assert sorted(got[:-1]) == sorted((at(m), int((m > edges).sum())) for m in minutes)
    assert got[-1] == (None, None)
    assert modelling.time_series_folds(df.limit(0)).count() == 0
    assert {r.chunk for r in modelling.time_series_folds(df.where("sensor_block_end IS NOT NULL").limit(1)).collect()} == {0}


def test_users_are_numbered_by_first_appearance(spark):
    rows = [("b", 0), ("a", 0), ("c", 500), ("d", 61), ("c", 900)]
    table = lambda rows: spark.createDataFrame([(c, None if m is None else at(m)) for c, m in rows], "customer string, sensor_block_end timestamp")
    got = modelling.encode_users(table(rows), table([("z", 1), ("a", -5), ("n", None), ("e", 3)]))
    assert {r.customer: r.user_index for r in got.collect()} == {"a": 0, "b": 1, "d": 2, "c": 3, "n": 4, "z": 5, "e": 6}


def test_many_answers_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(ema, "ANSWERS", 50)
    answers = spark.range(800).selectExpr("id % 40 element", "id % 20 question").coalesce(1)
    choice, questions = answers.distinct(), spark.range(20).selectExpr("id question", "1 questionnaire")
    found = ema.build_ema_long(answers, choice, questions, spark.sql("SELECT 1 questionnaire, 'a' name"))
    tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 800 and len(tasks) > 8 and max(tasks) < 200
