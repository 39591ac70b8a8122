"""Readers, writers, streams and the end-to-end jobs."""

import datetime
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pulsegrid.jobs import fixtures, pipelines, registry
from pulsegrid.operators import availability, monitoring, relational
from pulsegrid.sources import readers
from pulsegrid.streaming import alerts, ingest, streams

EPOCH = "customer,type,startTimestamp,endTimestamp,timezoneOffset,doubleValue,longValue,booleanValue,dateValue,stringValue,valueType,createdAt,source,trustworthiness,medicalGrade,generation\n"


def test_epochs_to_store(spark, tmp_path):
    (tmp_path / "epoch_part1.csv").write_bytes((EPOCH + "abcdef@x,HeartRate,1704456000000,1704456060000,3600000,,70,,,,,1,ü,,,\n").encode("latin-1"))
    (tmp_path / "epoch_part2.csv").write_bytes((EPOCH + "zz,Steps,1704456000000,1704456060000,,12.5,,,,,,1,,,,\n").encode("latin-1"))
    raw = readers.read_epochs(spark, f"{tmp_path}/epoch_part*.csv")
    assert raw.where("source = 'ü'").count() == 1
    roster = spark.createDataFrame([("abcd", "s"), ("none", "t")], "customer string, status string")
    clean = pipelines.ingest(raw, roster)
    rows = {r.customer: r for r in clean.collect()}
    assert set(rows) == {"abcd", "none"} and rows["abcd"].startTimestamp == datetime.datetime(2024, 1, 5, 13) and rows["none"].type is None
    readers.write_dataset(clean.where("type is not null"), f"{tmp_path}/store")
    assert readers.read_dataset(spark, f"{tmp_path}/store").where("type = 'HeartRate'").count() == 1
    assert pipelines.ingest(raw, roster, readers.read_dataset(spark, f"{tmp_path}/store")).where("type is not null").count() == 0


def test_other_readers(spark, tmp_path):
    (tmp_path / "sensor_backup_2024-01-05_3.csv").write_text(EPOCH + "abcd,Steps,2024-01-05T12:00:00+00:00,oops,,1.0,,,,,,,,,,\n")
    row = readers.read_backups(spark, f"{tmp_path}/sensor_backup_*.csv").first()
    assert (row.date, row["index"], row.endTimestamp) == (datetime.date(2024, 1, 5), 3, None) and row.startTimestamp.hour == 12
    (tmp_path / "roster.csv").write_text("FOR_ID,EMA_ID,Pseudonym,Studienversion,Status,Start EMA Baseline,Ende EMA Baseline\n FOR1 ,e1,abcdXY,Lang,Dropout,\"Mo, 01.02.2024\",15.02.2024\n")
    row = readers.read_roster(spark, f"{tmp_path}/roster.csv").first()
    assert (row.for_id, row.customer, row.ema_base_start) == ("FOR1", "abcd", datetime.date(2024, 2, 1))
    for name, (schema, _) in readers.EMA_TABLES.items():
        (tmp_path / f"{name}.csv").write_text(",".join(c.split()[0] for c in schema.split(", ")) + "\n")
    assert set(readers.read_ema_export(spark, str(tmp_path))) == set(readers.EMA_TABLES)
    (tmp_path / "c.csv").write_text(",".join(readers.CLINICAL_COLUMNS) + ",more\nFOR1" + "," * len(readers.CLINICAL_COLUMNS) + "x\n")
    assert readers.read_clinical(spark, [f"{tmp_path}/c.csv"] * 2).count() == 2
    (tmp_path / "w.csv").write_text("date,apparent_temperature_mean,sunshine_duration,precipitation_hours\n2024-01-05,3.5,7200,1\n")
    assert readers.read_weather(spark, f"{tmp_path}/w.csv").first().sunshine_duration == 2
    readers.write_csv(spark.range(3), f"{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").count() == 3


def test_features_end_to_end(spark):
    """A person at home all night, and prompts with known readings before them."""
    t = datetime.datetime(2024, 1, 5)
    hours = [t + datetime.timedelta(minutes=30 * i) for i in range(48 * 8)]
    gps_rows = [("u", k, h, h, v, None) for h in hours for k, v in (("Latitude", 52.5 if h.hour < 9 or h.hour > 17 else 52.6), ("Longitude", 13.4))]
    hr = [("u", "HeartRate", h, h + datetime.timedelta(minutes=10), None, 60 + h.hour) for h in hours]
    sensor = spark.createDataFrame(gps_rows + hr, "customer string, type string, startTimestamp timestamp, endTimestamp timestamp, doubleValue double, longValue long")
    prompts = [("u", t + datetime.timedelta(days=d, hours=h), i, "3") for d in range(8) for h in (8, 12, 16, 20) for i in ("sad", "afraid")]
    ema = spark.createDataFrame(prompts, "customer string, quest_create timestamp, quest_title string, choice_text string")
    ema = ema.withColumns({"quest_create_day": F.to_date("quest_create"), "unique_day_id": F.date_format("quest_create", "yyyyMMdd_H")})
    out = pipelines.features(sensor, ema, ["sad", "afraid"], min_data_points=50, min_samples=5).collect()
    assert len(out) == 32
    by = {r.unique_day_id: r for r in out}
    evening, noon = by["20240106_20"], by["20240106_12"]
    assert evening.mean_na == 3 and evening.at_home_minute == 120 and noon.at_home_minute == 0
    assert evening.hr_min == 78 and evening.hr_max == 80 and evening.n_steps == -1


def finished(query):
    query.processAllAvailable()
    query.stop()


def test_hourly_stream_equals_batch(spark, sf, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    sensor = fixtures.sensor(spark, sf).unionByName(fixtures.sensor(spark, sf).limit(20))
    source = f"{tmp_path}/in"
    sensor.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(sensor.schema).parquet(source)
    hours = streams.stream_hourly_availability(stream, "60 days").writeStream.outputMode("update").format("memory").queryName("hours").start()
    finished(hours)
    batch = availability.hourly_presence(sensor).count()
    assert spark.table("hours").dropDuplicates(["customer", "type", "hour_start"]).count() == batch


RAW = readers.EPOCHS
MORNING = datetime.datetime(2024, 1, 5, 8, tzinfo=datetime.timezone.utc)


def raw_rows(spark, rows):
    """(customer, type, minutes after the morning, value) as raw records."""
    at = lambda m: int(MORNING.timestamp() * 1000) + 60_000 * m
    full = [(f"{c}@x", t, at(m), at(m + 5), 0, float(v), v, *[None] * 3, *[None] * 6) for c, t, m, v in rows]
    return spark.createDataFrame(full, RAW)


def ingested(spark, source, target, checkpoint, roster, lateness="2 days"):
    return ingest.stream_ingest(spark.readStream.schema(RAW).parquet(source), roster, target, checkpoint, lateness)


def as_set(df):
    return sorted(map(str, df.select("customer", "type", "startTimestamp", "endTimestamp", "start_end", "longValue", "status").collect()))


def test_times_of_one_millisecond_are_different_keys(spark, tmp_path):
    event = "id event_id, timestamp_micros(1704456000000000 + 400 * id) ts, 1L user_id, 'view' event_type, 70D value, '{\"k\": 1}' props"
    spark.range(4).selectExpr(*event.split(", ")).write.parquet(f"{tmp_path}/events.parquet")
    spark.sql("SELECT 1L c_custkey, 1 c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    found = registry.QUERIES["x1_stream_ingest"](spark, str(tmp_path)).collect()
    assert [(r.part, r.n, r.longs) for r in found] == [("store", 4, 360)]  # in two milliseconds


def test_killed_ingest_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    source, target, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "ck"))
    roster = spark.createDataFrame([("aaaa", "s"), ("bbbb", "t"), ("idle", "u")], "customer string, status string")
    parts = [[("aaaa", "Steps", m, m) for m in range(0, 60, 5)] + [("gone", "Steps", 1, 1), ("aaaa", None, 3, 3)],
             [("aaaa", "Steps", m, m) for m in range(30, 90, 5)] + [("bbbb", "HeartRate", 10, 9), ("bbbb", "HeartRate", 10, 8), ("aaaa", None, 3, 3)]]
    raw_rows(spark, parts[0]).coalesce(1).write.parquet(source)
    ingested(spark, source, target, checkpoint, roster).awaitTermination()
    raw_rows(spark, parts[1]).coalesce(1).write.mode("append").parquet(source)
    with monkeypatch.context() as m:  # ends after the store is written, before the batch is closed
        m.setattr(ingest, "close_batch", lambda *a: 1 / 0)
        with pytest.raises(Exception):
            ingested(spark, source, target, checkpoint, roster).awaitTermination()
    half = ingest.read_store(spark, target)
    assert half.count() == 13 and half.where("batch > 0").count() == 0
    ingested(spark, source, target, checkpoint, roster).awaitTermination()
    everything = raw_rows(spark, parts[0] + parts[1])
    want = pipelines.ingest(everything, roster).where("startTimestamp is not null")
    want = relational.dedupe(want, ingest.KEY, ["longValue"])
    assert as_set(ingest.read_store(spark, target)) == as_set(want)
    done = {r.batch: (r.stored, r.repeated, r.late) for r in ingest.read_done(spark, target).collect()}
    assert done == {0: (13, 0, 0), 1: (7, 8, 0)}


def test_late_records_are_kept_aside(spark, tmp_path):
    source, target, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "ck"))
    roster = spark.createDataFrame([("aaaa", "s")], "customer string, status string")
    for rows in ([("aaaa", "Steps", 500, 1)], [("aaaa", "Steps", 0, 2), ("aaaa", "Steps", 0, 3), ("aaaa", "Steps", 400, 4)], []):
        raw_rows(spark, rows).coalesce(1).write.mode("append").parquet(source)
        ingested(spark, source, target, checkpoint, roster, "2 hours").awaitTermination()
    assert sorted(r.longValue for r in ingest.read_store(spark, target).collect()) == [1, 4]
    assert sorted(r.longValue for r in ingest.read_late(spark, target).collect()) == [2, 3]


def test_store_of_nothing(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    raw_rows(spark, []).coalesce(1).write.parquet(source)
    ingested(spark, source, target, f"{tmp_path}/ck", spark.createDataFrame([("aaaa", "s")], "customer string, status string")).awaitTermination()
    assert ingest.read_store(spark, target).count() == 0 and ingest.read_late(spark, target).count() == 0


def test_a_type_and_day_takes_several_files(spark, tmp_path):
    rows = spark.range(40_000).selectExpr("cast(id % 50 as string) customer", "'Steps' type", "timestamp'2024-01-05' + make_interval(0, 0, 0, 0, 0, 0, id % 80000) startTimestamp", "uuid() note")
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128k")
    try:
        readers.write_dataset(rows.repartition(8), f"{tmp_path}/store")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    back = readers.read_dataset(spark, f"{tmp_path}/store")
    assert back.count() == 40_000 and len(back.inputFiles()) > 2


READING = "customer string, type string, startTimestamp timestamp, endTimestamp timestamp, doubleValue double, longValue long"


def test_block_stream_tells_blocks_without_readings(spark, tmp_path):
    t = lambda h, m=0: datetime.datetime(2024, 1, 5, h, m)
    readings = [("a", "HeartRate", t(9), t(9, 10), None, 50), ("a", "HeartRate", t(9, 50), t(10, 10), None, 70), ("a", "HeartRate", t(5), t(5, 1), None, 90), ("a", "Steps", t(7, 30), t(8, 30), 60.0, None), ("b", "HeartRate", t(9), t(9), None, 300)]
    prompts = [("a", "a1", t(10)), ("b", "b1", t(10)), ("c", "c1", t(11))]
    parts = [(readings[:3], prompts[:2]), (readings[3:], prompts[2:]), ([("z", "HeartRate", t(23), t(23), None, 60)], [("z", "z1", t(23))])]
    for i, (r, p) in enumerate(parts):
        spark.createDataFrame(r, READING).coalesce(1).write.mode("append").parquet(f"{tmp_path}/r")
        spark.createDataFrame(p, "customer string, unique_blocks string, sensor_block_end timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/p")
        read = lambda n, s: spark.readStream.schema(s).parquet(f"{tmp_path}/{n}")
        found = streams.stream_block_features(read("r", READING), read("p", "customer string, unique_blocks string, sensor_block_end timestamp"), 2, "4 hours", "2 hours")
        found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    got = {r.unique_blocks: r for r in spark.read.schema(found.schema).parquet(f"{tmp_path}/out").collect()}
    assert set(got) == {"a1", "b1", "c1"}
    assert (got["a1"].hr_mean, got["a1"].hr_zone_resting, got["a1"].hr_zone_moderate, got["a1"].n_steps) == (60, 10, 10, 30)
    assert (got["b1"].hr_mean, got["b1"].n_steps, got["c1"].hr_mean, got["c1"].activity_102_minutes) == (-1, -1, -1, -1)


def test_alerts_equal_the_batch_after_every_run(spark, tmp_path):
    rng = random.Random(3)
    schema = "customer string, type string, startTimestamp timestamp"
    people = spark.createDataFrame([(f"c{i}", f"F{i}", "Erhebung_1_aktiv" if i % 5 else "Dropout") for i in range(14)], "customer string, for_id string, status string")
    at, fed, told, ended = datetime.datetime(2024, 1, 1), [], set(), set()
    for _ in range(5):
        at += datetime.timedelta(days=4)
        rows = [(f"c{rng.randrange(16)}", rng.choice(["Latitude", "HeartRate", "Steps"]), at - datetime.timedelta(hours=rng.randrange(96))) for _ in range(14)]
        rows = [r for r in rows if r[0] != "c1"] + [("c15", "Latitude", at), ("c1", "Latitude", at)]
        rows += [("c1", "HeartRate", at)] if not fed else []  # a watch that was worn at first
        fed += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = alerts.stream_interruptions(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), people, 3, "1 day", no_watch=("F3",), no_gps=("F4",))
        log = lambda df, batch: df.write.mode("overwrite").parquet(f"{tmp_path}/log/batch={batch}")
        with alerts.rocks(spark):
            stream.writeStream.foreachBatch(log).outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
        changes = spark.read.schema(alerts.CHANGES).parquet(f"{tmp_path}/log")
        got = {(r.customer, r.for_id, r.category) for r in alerts.current_alerts(changes).collect()}
        clock = (max(r[2] for r in fed) - datetime.timedelta(days=1)).replace(hour=0)
        sensor = spark.createDataFrame(fed, schema)
        table = people.where("status != 'Dropout'").join(availability.last_seen(sensor, ["Latitude"], "last_day_GPS"), "customer", "left").join(availability.last_seen(sensor, ["HeartRate"], "last_day_passive"), "customer", "left")
        want = monitoring.interruptions(table, clock - datetime.timedelta(days=3), ["F3"], ["F4"])
        assert got == {tuple(r) for r in want.collect()}
        told |= {c for _, _, c in got}
        ended |= {r.customer for r in changes.where("category is null").collect()}
    assert told == {"no_pd", "no_gps", "no_gpspd", "no_gps_at_all"} and ended


def test_watch_asks_for_its_state_once_a_call():
    """A timer or a batch of a participant costs one look, and a change one update."""
    calls, day = [], alerts.DAY_MS

    class Seen:
        held = ("F1", -1, -1, "", 0)

        def get(self):
            calls.append("get")
            return self.held

        def update(self, state):
            calls.append("update")
            self.held = state

    class Clock:
        getCurrentWatermarkInMs = staticmethod(lambda: 10 * day + 5)

    watch = alerts.Watch(3, (), ())
    watch.seen, watch.handle = Seen(), type("Handle", (), {"registerTimer": lambda self, at: calls.append(at)})()
    assert [r.category for r in watch.handleExpiredTimer(("c",), Clock, None)] == ["no_gps_at_all"] and calls == ["get", "update"]
    del calls[:]
    rows = [Row(at=9 * day, located=True), Row(at=8 * day, located=True), Row(at=2 * day, located=False)]
    assert [(r.category, r.number) for r in watch.handleInputRows(("c",), iter(rows), Clock)] == [("no_pd", 2)]
    assert calls.count("get") == 1 and calls.count("update") == 1 and 13 * day in calls
    del calls[:]
    assert not list(watch.handleInputRows(("c",), iter(rows), Clock)) and calls == ["get"]


def test_bucketed_store_needs_no_exchange(spark, tmp_path):
    rows = spark.range(3000).selectExpr("concat('c', id % 40) customer", "timestamp'2024-01-05' + make_interval(0, 0, 0, 0, 0, 0, id * 7919 % 80000) startTimestamp", "id longValue")
    held = readers.compact_bucketed(rows.repartition(5), f"{tmp_path}/buckets", 4)
    gaps, other = readers.longest_gaps(held), held.select("customer", F.col("longValue").alias("v")).groupBy("customer").agg(F.max("v"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = gaps.join(other, "customer")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, gaps.collect())) == sorted(map(str, readers.longest_gaps(rows).collect())) and joined.count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sketches_stay_within_their_bound(spark):
    rows = spark.range(60_000).selectExpr("'Steps' type", "concat('c', id % 20000) customer", "timestamp'2024-01-01' + make_interval(0, 0, 0, id % 10, 0, 0, 0) startTimestamp")
    days = availability.daily_sketches(rows.where("startTimestamp < '2024-01-08'"))
    more = days.unionByName(availability.daily_sketches(rows.where("startTimestamp >= '2024-01-08'")))  # later days, added alone
    got = {r.upto.day: r.participants for r in availability.participants_over_time(more, 3).collect()}
    for upto in range(1, 11):
        exact = rows.where(F.dayofmonth("startTimestamp").between(upto - 2, upto)).select("customer").distinct().count()
        assert abs(got[upto] - exact) <= 0.05 * exact


def test_participants_over_time_are_exact(spark):
    rows = spark.range(30_000).selectExpr("if(id % 3 = 0, 'Steps', 'HeartRate') type", "concat('c', id * 7919 % 5003) customer", "timestamp'2024-01-01' + make_interval(0, 0, 0, id * id % 19, 0, 0, 0) startTimestamp")
    rows = rows.where("NOT (type = 'Steps' AND dayofmonth(startTimestamp) BETWEEN 8 AND 12)")  # no row where a type has nothing in the days
    got = {(r.type, r.upto.day): (r.participants, r.person_days) for r in availability.exact_participants_over_time(availability.daily_participants(rows), 3).collect()}
    held = [(r.type, r.startTimestamp.day, r.customer) for r in rows.collect()]
    want = {}
    for upto in {d for _, d, _ in held}:
        for kind in ("Steps", "HeartRate"):
            own = {(d, c) for t, d, c in held if t == kind and upto - 3 < d <= upto}
            if own:
                want[kind, upto] = (len({c for _, c in own}), len(own))
    assert got == want


def test_participants_over_time_tell_every_day_of_the_table(spark, tmp_path):
    rows = spark.range(400).selectExpr(
        "id event_id", "timestamp'2024-01-01 09:00:00' + make_interval(0, 0, 0, id * id % 47, 0, 0, 0) ts", "id * 7 % 31 user_id", "if(id % 3 = 0, 'view', 'click') event_type", "1.5D value", "'{\"k\": 3}' props"
    )
    alone = "to_date(ts) = '2024-02-04' OR event_type = 'view' AND to_date(ts) < '2024-01-20'"  # records that name no one
    rows = rows.withColumn("user_id", F.expr(f"if({alone}, NULL, user_id)"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    held = [({"view": "HeartRate", "click": "Steps"}[r.event_type], r.ts.date(), r.user_id) for r in rows.collect()]
    want = set()
    for upto in {d for _, d, _ in held}:
        for kind in ("HeartRate", "Steps"):
            own = {(d, c) for t, d, c in held if t == kind and 0 <= (upto - d).days < 7}
            named = {(d, c) for d, c in own if c is not None}
            if own:
                want.add((kind, str(upto), len({c for _, c in named}), len(named)))
    got = registry.QUERIES["a25_participants_over_time"](spark, str(tmp_path)).collect()
    assert {(r.type, r.upto, r.participants, r.person_days) for r in got} == want and len(got) == len(want)
    assert max(r.upto for r in got) > "2024-02-01" and [r for r in got if not r.participants]
