"""Queries on sensor records, blocks, GPS and availability."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import SQL, TODAY, _hav, av, codes, ema, fx, gps, intervals, monitoring, quality, query, r6, relational, rounded, sensors, stamp, with_tables

_SECS = "(epoch_us({1}) - epoch_us({0})) / 1e6"
_OVER = "JOIN blocks b ON b.customer = s.customer AND s.start <= b.b1 AND s.stop >= b.b0"
_OSEC = "(epoch_us(least(s.stop, b.b1)) - epoch_us(greatest(s.start, b.b0))) / 1e6"


@query("p17_clean_heart_rate", with_tables("SELECT customer, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, CAST(lv AS DOUBLE) AS bpm FROM sensor WHERE type = 'HeartRate' AND lv BETWEEN 30 AND 220", "sensor"))
def _(spark, sf):
    rows = sensors.clean_heart_rate_data(sensors.filter_types(fx.sensor(spark, sf), ["HeartRate"]))
    return rows.select("customer", stamp("startTimestamp").alias("start"), F.col("longValue").alias("bpm"))


@query("p17_heart_rate_report", with_tables("SELECT count(*) AS n_rows, count_if(lv IS NULL) AS n_not_numeric, count_if(lv < 30) AS n_low, count_if(lv > 220) AS n_high, count_if(lv BETWEEN 30 AND 220) AS n_kept FROM sensor WHERE type = 'HeartRate'", "sensor"))
def _(spark, sf):
    return sensors.heart_rate_cleaning_report(sensors.filter_types(fx.sensor(spark, sf), ["HeartRate"]))


_STEPS = "clean AS (SELECT * FROM sensor WHERE type = 'Steps' AND dv >= 0 AND stop > start AND dv / ((epoch_us(stop) - epoch_us(start)) / 1e6 / 60) <= 200) "


@query("p18_clean_steps", with_tables(_STEPS + "SELECT customer, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, round(dv, 6) AS steps FROM clean", "sensor"))
def _(spark, sf):
    rows = sensors.clean_step_data(sensors.filter_types(fx.sensor(spark, sf), ["Steps"]))
    return rows.select("customer", stamp("startTimestamp").alias("start"), r6("doubleValue").alias("steps"))


@query("p18_step_report", with_tables("SELECT count(*) AS n_rows, count_if(dv IS NULL) AS n_not_numeric, count_if(dv < 0) AS n_negative, count_if(dv >= 0 AND stop <= start) AS n_no_duration, count_if(dv >= 0 AND stop > start AND dv / ((epoch_us(stop) - epoch_us(start)) / 6e7) > 200) AS n_fast, count_if(dv >= 0 AND stop > start AND dv / ((epoch_us(stop) - epoch_us(start)) / 6e7) <= 200) AS n_kept FROM sensor WHERE type = 'Steps'", "sensor"))
def _(spark, sf):
    return sensors.step_cleaning_report(sensors.filter_types(fx.sensor(spark, sf), ["Steps"]))


@query("p19_exclude_types", with_tables("SELECT type, count(*) AS n FROM sensor WHERE type NOT IN ('Latitude', 'Longitude') GROUP BY 1", "sensor"))
def _(spark, sf):
    return relational.count_by(sensors.filter_types(fx.sensor(spark, sf), ["Latitude", "Longitude"], negate=True), "type")


@query("j5_overlap_join", with_tables(f"SELECT b.unique_blocks, s.type, strftime(s.start, '%Y-%m-%d %H:%M:%S') AS start, round({_OSEC}, 6) AS overlap_seconds FROM sensor s {_OVER}", "sensor", "blocks"))
def _(spark, sf):
    pairs = intervals.overlap_join(fx.sensor(spark, sf), fx.blocks(spark, sf))
    return pairs.select("unique_blocks", "type", stamp("startTimestamp").alias("start"), r6("overlap_seconds").alias("overlap_seconds"))


@query("j6_point_in_block", with_tables("SELECT b.unique_blocks, strftime(p.ts, '%Y-%m-%d %H:%M:%S') AS at, p.cluster FROM places p JOIN blocks b ON b.customer = p.customer AND p.ts BETWEEN b.b0 AND b.b1", "places", "blocks"))
def _(spark, sf):
    pairs = intervals.point_in_block_join(fx.places(spark, sf), fx.blocks(spark, sf))
    return pairs.select("unique_blocks", stamp("startTimestamp").alias("at"), "cluster")


@query("j7_prefilter_time_range", with_tables("SELECT s.customer, s.type, count(*) AS n FROM sensor s JOIN (SELECT customer, min(b0) AS lo, max(b1) AS hi FROM blocks GROUP BY 1) r ON r.customer = s.customer AND s.stop >= r.lo AND s.start <= r.hi GROUP BY 1, 2", "sensor", "blocks"))
def _(spark, sf):
    return intervals.prefilter_time_range(fx.sensor(spark, sf), fx.blocks(spark, sf)).groupBy("customer", "type").agg(F.count("*").alias("n"))


@query(
    "a19_heart_rate_blocks",
    with_tables(
        f"""m AS (SELECT b.unique_blocks, avg(lv) AS a, min(lv) AS mi, max(lv) AS ma, stddev_pop(lv) AS sd,
              sum(CASE WHEN lv < 60 THEN {_OSEC} / 60 ELSE 0 END) AS z1, sum(CASE WHEN lv >= 60 AND lv < 100 THEN {_OSEC} / 60 ELSE 0 END) AS z2, sum(CASE WHEN lv >= 100 THEN {_OSEC} / 60 ELSE 0 END) AS z3
              FROM (SELECT * FROM sensor WHERE type = 'HeartRate' AND lv BETWEEN 30 AND 220) s {_OVER} GROUP BY 1)
        SELECT b.customer, b.unique_blocks, round(coalesce(a, -1), 6) AS hr_mean, CAST(coalesce(mi, -1) AS DOUBLE) AS hr_min, CAST(coalesce(ma, -1) AS DOUBLE) AS hr_max, round(coalesce(sd, -1), 6) AS hr_std,
               round(coalesce(z1, -1), 6) AS hr_zone_resting, round(coalesce(z2, -1), 6) AS hr_zone_moderate, round(coalesce(z3, -1), 6) AS hr_zone_vigorous FROM blocks b LEFT JOIN m USING (unique_blocks)""",
        "sensor", "blocks",
    ),
)
def _(spark, sf):
    return rounded(sensors.map_heart_rate_to_ema(fx.blocks(spark, sf), sensors.clean_heart_rate_data(sensors.filter_types(fx.sensor(spark, sf), ["HeartRate"]))))


@query(
    "a20_step_blocks",
    with_tables(
        _STEPS.rstrip() + f""", m AS (SELECT b.unique_blocks, sum(dv * ({_OSEC}) / ((epoch_us(s.stop) - epoch_us(s.start)) / 1e6)) AS x FROM clean s {_OVER} GROUP BY 1)
        SELECT b.customer, b.unique_blocks, coalesce(CAST(trunc(x) AS BIGINT), -1) AS n_steps FROM blocks b LEFT JOIN m USING (unique_blocks)""",
        "sensor", "blocks",
    ),
)
def _(spark, sf):
    return sensors.map_steps_to_ema(fx.blocks(spark, sf), sensors.clean_step_data(sensors.filter_types(fx.sensor(spark, sf), ["Steps"])))


_ACT = ", ".join(f"sum(CASE WHEN lv = {c} THEN {_OSEC} / 60 ELSE 0 END) AS x{c}" for c in codes.ACTIVITY_CODES)


@query(
    "a21_activity_blocks",
    with_tables(
        f"m AS (SELECT b.unique_blocks, {_ACT} FROM (SELECT * FROM sensor WHERE type = 'ActivityType') s {_OVER} GROUP BY 1) SELECT b.customer, b.unique_blocks, "
        + ", ".join(f"round(coalesce(x{c}, -1), 6) AS activity_{c}_minutes" for c in codes.ACTIVITY_CODES) + " FROM blocks b LEFT JOIN m USING (unique_blocks)",
        "sensor", "blocks",
    ),
)
def _(spark, sf):
    return rounded(sensors.map_activity_types_to_ema(fx.blocks(spark, sf), sensors.filter_types(fx.sensor(spark, sf), ["ActivityType"])))


def _flagged(spark, sf):
    """Places with flags: at home in cluster 0, moving on odd seconds."""
    moving = (F.second("startTimestamp") % 2).cast("int")
    return fx.places(spark, sf).withColumns({"at_home": (F.col("cluster") == 0).cast("int"), "transition": moving, "stationary": 1 - moving})


@query(
    "a22_gps_blocks",
    with_tables(
        f"""p AS (SELECT b.unique_blocks, b.b1, ts, lat, lon, CASE WHEN cluster = 0 THEN 1 ELSE 0 END AS home, second(ts) % 2 AS mv FROM places q JOIN blocks b ON b.customer = q.customer AND q.ts BETWEEN b.b0 AND b.b1),
        l AS (SELECT *, (epoch_us(coalesce(lead(ts) OVER w, b1)) - epoch_us(ts)) / 1e6 / 60 AS mins, coalesce({_hav('lat', 'lon', 'lead(lat) OVER w', 'lead(lon) OVER w')}, 0) AS metres FROM p WINDOW w AS (PARTITION BY unique_blocks ORDER BY ts)),
        m AS (SELECT unique_blocks, count(*) AS n, sum(metres) / 1000 AS km, sum(home * mins) AS h, sum(mv * mins) AS tr, sum((1 - mv) * mins) AS st FROM l GROUP BY 1)
        SELECT b.customer, b.unique_blocks, coalesce(n, -1) AS n_GPS, round(coalesce(km, -1), 6) AS total_distance_km, round(coalesce(h, -1), 6) AS at_home_minute, round(coalesce(tr, -1), 6) AS time_in_transition_minutes,
        round(coalesce(st, -1), 6) AS time_stationary_minutes FROM blocks b LEFT JOIN m USING (unique_blocks)""",
        "places", "blocks",
    ),
)
def _(spark, sf):
    return rounded(sensors.map_gps_and_transition_to_ema(fx.blocks(spark, sf), _flagged(spark, sf)))


def _block_table(spark, sf):
    """All features of the fixture blocks in one row each."""
    from .pipelines import block_features

    return block_features(fx.sensor(spark, sf), fx.blocks(spark, sf), _flagged(spark, sf))


_PARTS = [SQL[n] for n in ("a19_heart_rate_blocks", "a20_step_blocks", "a21_activity_blocks", "a22_gps_blocks")]


@query("flagship_block_features", f"SELECT * FROM ({_PARTS[0]})" + "".join(f" JOIN ({p}) USING (customer, unique_blocks)" for p in _PARTS[1:]))
def _(spark, sf):
    return rounded(_block_table(spark, sf).drop("sensor_block_start", "sensor_block_end"))


# -- GPS ---------------------------------------------------------------------


@query("a9_pivot_gps", with_tables("SELECT customer, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, round(lat, 6) AS \"Latitude\", round(lon, 6) AS \"Longitude\" FROM places", "places"))
def _(spark, sf):
    return gps.pivot_gps(fx.sensor(spark, sf)).select("customer", stamp("startTimestamp").alias("at"), r6("Latitude").alias("Latitude"), r6("Longitude").alias("Longitude"))


@query("g1_data_quality_check", with_tables("SELECT customer, count(*) AS n FROM places GROUP BY 1 HAVING count(*) >= 10", "places"))
def _(spark, sf):
    return relational.count_by(gps.data_quality_check(fx.places(spark, sf), 10), "customer")


_SPEED = f"""sp AS (SELECT *, coalesce({_hav('lat', 'lon', 'lead(lat) OVER w', 'lead(lon) OVER w')}, 0) AS distance, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 0) AS time_diff FROM places WINDOW w AS (PARTITION BY customer ORDER BY ts)),
    sq AS (SELECT *, CASE WHEN time_diff <> 0 THEN distance / time_diff END AS speed FROM sp) """


@query("w1_distances_and_speeds", with_tables(_SPEED + "SELECT customer, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, round(distance, 4) AS distance, round(time_diff, 6) AS time_diff, round(speed, 6) AS speed FROM sq", "places"))
def _(spark, sf):
    df = gps.calculate_distances_and_speeds(fx.places(spark, sf))
    return df.select("customer", stamp("startTimestamp").alias("at"), F.round("distance", 4).alias("distance"), r6("time_diff").alias("time_diff"), r6("speed").alias("speed"))


@query("g2_stationary_and_transition", with_tables(_SPEED + "SELECT customer, CAST(sum(CASE WHEN speed < 1.4 AND distance < 150 THEN 1 ELSE 0 END) AS BIGINT) AS stationary, CAST(sum(CASE WHEN speed >= 1.4 THEN 1 ELSE 0 END) AS BIGINT) AS transition, count(*) AS n FROM sq WHERE speed IS NOT NULL AND speed * 3.6 <= 220 GROUP BY 1", "places"))
def _(spark, sf):
    df = gps.calculate_stationary_and_transition(gps.calculate_distances_and_speeds(fx.places(spark, sf)))
    return df.groupBy("customer").agg(F.sum("stationary").alias("stationary"), F.sum("transition").alias("transition"), F.count("*").alias("n"))


# Places lie 2 km apart and their points within 50 m, so clusters are the places with enough points.
_PLACE = "round((lat - 52.5) / 0.02 - 0.003)"


@query("g3_dbscan_summary", with_tables(f"n AS (SELECT customer, count(*) OVER (PARTITION BY customer) >= 3 AND count(*) OVER (PARTITION BY customer, {_PLACE}) >= 2 AS placed, {_PLACE} AS place FROM places) SELECT customer, count_if(NOT placed) AS n_noise, count_if(placed) AS n_clustered, count(DISTINCT CASE WHEN placed THEN place END) AS n_clusters FROM n GROUP BY 1", "places"))
def _(spark, sf):
    return gps.cluster_summary(gps.dbscan(fx.places(spark, sf).drop("cluster"), min_samples=2, min_data_points=3))


#: All events as points 45 to 55 m apart, so that clusters grow along chains of points.
_GRID = "52.5 + 0.0005 * (k % 10) + 0.00001 * (id % 7) AS lat, 13.4 + 0.0007 * (k // 10) + 0.00001 * (id % 5) AS lon"


@query(
    "g3_dbscan_labels",
    with_tables(
        f"""RECURSIVE p AS (SELECT customer, id, ts, {_GRID} FROM ev),
        near AS (SELECT a.customer, a.id, a.ts, b.id AS other FROM p a JOIN p b ON a.customer = b.customer AND {_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 60),
        core AS (SELECT customer, id, ts FROM near GROUP BY ALL HAVING count(*) >= 4),
        links AS (SELECT id, other FROM near WHERE id IN (SELECT id FROM core) AND other IN (SELECT id FROM core)),
        reach(id, other) AS (SELECT id, other FROM links UNION SELECT r.id, l.other FROM reach r JOIN links l ON r.other = l.id),
        begun AS (SELECT r.id, min((c.ts, c.id)) AS first FROM reach r JOIN core c ON c.id = r.other GROUP BY 1),
        num AS (SELECT c.id, dense_rank() OVER (PARTITION BY customer ORDER BY first) - 1 AS cluster FROM core c JOIN begun USING (id)),
        l AS (SELECT n.id, min(m.cluster) AS cluster FROM near n JOIN num m ON m.id = n.other GROUP BY 1)
        SELECT p.customer, p.id, CAST(coalesce(c.cluster, l.cluster, -1) AS INT) AS cluster FROM p LEFT JOIN num c USING (id) LEFT JOIN l USING (id)"""
    ).replace("WITH ev", "WITH RECURSIVE ev").replace(", RECURSIVE p", ", p"),
)
def _(spark, sf):
    """Every participant by joins over many tasks, none in one task."""
    e, id_ = fx.events(spark, sf), F.col("id")
    lat = 52.5 + 0.0005 * (F.col("k") % 10) + 0.00001 * (id_ % 7)
    lon = 13.4 + 0.0007 * F.floor(F.col("k") / 10) + 0.00001 * (id_ % 5)
    points = e.select("customer", "id", F.col("ts").alias("startTimestamp"), lat.alias("Latitude"), lon.alias("Longitude"))
    return gps.dbscan(points, 60, 4, 1, in_one_task=0).select("customer", "id", "cluster")


_EXTRACT = _SPEED + f""", gate AS (SELECT customer FROM places GROUP BY 1 HAVING count(*) >= 5),
    moved AS (SELECT customer, ts, {_PLACE} AS place FROM sq JOIN gate USING (customer) WHERE speed IS NOT NULL AND speed * 3.6 <= 220),
    m AS (SELECT *, count(*) OVER (PARTITION BY customer) >= 5 AND count(*) OVER (PARTITION BY customer, place) >= 2 AS placed, min(ts) OVER (PARTITION BY customer, place) AS begun FROM moved),
    d AS (SELECT customer, place, row_number() OVER (PARTITION BY customer ORDER BY begun) - 1 AS number FROM (SELECT DISTINCT customer, place, begun FROM m WHERE placed)),
    l AS (SELECT customer, ts, CASE WHEN placed THEN number ELSE -1 END AS cluster, hour(ts) >= 20 OR hour(ts) <= 6 AS night FROM m LEFT JOIN d USING (customer, place)),
    n AS (SELECT customer, cluster, count(*) AS n_all, count_if(night) AS n_night FROM l WHERE cluster <> -1 GROUP BY 1, 2),
    obs AS (SELECT customer, sum(n_night) AS obs FROM n GROUP BY 1),
    top AS (SELECT customer, cluster AS c1, n_night FROM n WHERE n_night > 0 QUALIFY row_number() OVER (PARTITION BY customer ORDER BY n_night DESC, cluster) = 1),
    big AS (SELECT customer, cluster AS c2 FROM n QUALIFY row_number() OVER (PARTITION BY customer ORDER BY n_all DESC, cluster) = 1),
    h AS (SELECT customer, CASE WHEN n_night * 1.0 / obs >= 0.5 THEN c1 ELSE c2 END AS home FROM big LEFT JOIN top USING (customer) LEFT JOIN obs USING (customer)) """


@query("g6_extract_home", with_tables(_EXTRACT + "SELECT customer, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, CAST(cluster AS INT) AS cluster, CAST(home AS INT) AS home, CASE WHEN cluster = -1 THEN -1 WHEN cluster = home THEN 1 ELSE 0 END AS at_home, CASE WHEN cluster <> -1 THEN customer || '00' || cluster END AS \"clusterID\", customer || '00' || home AS \"homeID\" FROM l LEFT JOIN h USING (customer)", "places"))
def _(spark, sf):
    df = gps.extract_home(fx.places(spark, sf).drop("cluster"), min_data_points=5, min_samples=2, min_nights_obs=1)
    return df.select("customer", stamp("startTimestamp").alias("at"), "cluster", "home", "at_home", "clusterID", "homeID")


@query("g8_adaptive_kmeans", with_tables(f"m AS (SELECT *, min(ts) OVER (PARTITION BY customer, {_PLACE}) AS begun FROM places) SELECT customer, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, CAST(dense_rank() OVER (PARTITION BY customer ORDER BY begun) - 1 AS INT) AS cluster FROM m", "places"))
def _(spark, sf):
    return gps.adaptive_kmeans(fx.places(spark, sf).drop("cluster")).select("customer", stamp("startTimestamp").alias("at"), "cluster")


#: Two spots 801 m apart: one centre is near enough to both only if neither has most visits.
_SPOTS = "SELECT customer, id, ts, k % 8 < 3 AS off FROM ev"


@query("g8_adaptive_kmeans_visits", with_tables(f"""v AS ({_SPOTS}), f AS (SELECT customer, avg(CAST(off AS INT)) AS share, {_hav('52.5', '13.4', '52.5072', '13.4')} AS d FROM v GROUP BY 1),
    m AS (SELECT v.*, greatest(share, 1 - share) * d > 500 AND share BETWEEN 0.001 AND 0.999 AS two, min(ts) OVER (PARTITION BY customer, off) AS begun FROM v JOIN f USING (customer)),
    r AS (SELECT *, dense_rank() OVER (PARTITION BY customer ORDER BY begun) - 1 AS number FROM m)
    SELECT customer, id, CAST(CASE WHEN two THEN number ELSE 0 END AS INT) AS cluster FROM r"""))  # fmt: skip
def _(spark, sf):
    """The number of visits of a spot decides, though all its points are equal."""
    e = fx.events(spark, sf)
    lat = F.when(F.col("k") % 8 < 3, 52.5072).otherwise(52.5)
    visits = e.select("customer", "id", F.col("ts").alias("startTimestamp"), lat.alias("Latitude"), F.lit(13.4).alias("Longitude"))
    return gps.adaptive_kmeans(visits).select("customer", "id", "cluster")


_HOME = """n AS (SELECT customer, cluster, count(*) AS n_all, count_if(hour(ts) >= 20 OR hour(ts) <= 6) AS n_night FROM places WHERE cluster <> -1 GROUP BY 1, 2),
    nights AS (SELECT customer, count(DISTINCT CAST(ts AS DATE)) AS nights, count(*) AS obs FROM places WHERE cluster <> -1 AND (hour(ts) >= 20 OR hour(ts) <= 6) GROUP BY 1),
    top AS (SELECT customer, cluster AS c1, n_night FROM n WHERE n_night > 0 QUALIFY row_number() OVER (PARTITION BY customer ORDER BY n_night DESC, cluster) = 1),
    big AS (SELECT customer, cluster AS c2 FROM n QUALIFY row_number() OVER (PARTITION BY customer ORDER BY n_all DESC, cluster) = 1),
    homes AS (SELECT c.customer, CASE WHEN nights >= 3 AND n_night * 1.0 / obs >= 0.3 THEN c1 ELSE c2 END AS home FROM (SELECT DISTINCT customer FROM places) c LEFT JOIN big USING (customer) LEFT JOIN top USING (customer) LEFT JOIN nights USING (customer)) """


def _homes(spark, sf):
    return gps.find_home_cluster(fx.places(spark, sf), 3, 0.3)


@query("g4_find_home_cluster", with_tables(_HOME + "SELECT customer, CAST(home AS INT) AS home FROM homes", "places"))
def _(spark, sf):
    return _homes(spark, sf)


@query("g5_at_home", with_tables(_HOME + "SELECT customer, CASE WHEN cluster = -1 THEN -1 WHEN cluster = home THEN 1 ELSE 0 END AS at_home, count(*) AS n FROM places JOIN homes USING (customer) GROUP BY 1, 2", "places"))
def _(spark, sf):
    df = gps.determine_if_at_home(fx.places(spark, sf).join(_homes(spark, sf), "customer"))
    return df.groupBy("customer", "at_home").agg(F.count("*").alias("n"))


@query("g7_identify_home", with_tables("SELECT DISTINCT customer, CAST(cluster AS INT) AS home FROM (SELECT customer, cluster FROM places GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY customer ORDER BY count(*) DESC, cluster) = 1)", "places"))
def _(spark, sf):
    return gps.identify_home(fx.places(spark, sf), "cluster").select("customer", "home").distinct()


@query("p34_compose_ids", with_tables("SELECT customer, CASE WHEN cluster <> -1 THEN customer || '00' || cluster END AS clusterID, customer || '000' AS homeID, count(*) AS n FROM places GROUP BY ALL", "places"))
def _(spark, sf):
    df = gps.compose_ids(fx.places(spark, sf).withColumn("home", F.lit(0)))
    return df.groupBy("customer", "clusterID", "homeID").agg(F.count("*").alias("n"))


@query("a39_cluster_summary", with_tables("SELECT customer, count_if(cluster = -1) AS n_noise, count_if(cluster <> -1) AS n_clustered, count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS n_clusters FROM places GROUP BY 1", "places"))
def _(spark, sf):
    return gps.cluster_summary(fx.places(spark, sf))


@query("a16_transition_time", with_tables(f"g AS (SELECT customer, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6 AS s, {_hav('lat', 'lon', 'lead(lat) OVER w', 'lead(lon) OVER w')} AS m FROM places WINDOW w AS (PARTITION BY customer ORDER BY ts)) SELECT customer, round(coalesce(100 * sum(CASE WHEN s > 0 AND m / s >= 1.4 THEN s ELSE 0 END) / nullif(sum(s), 0), 0), 6) AS transition_time FROM g GROUP BY 1", "places"))
def _(spark, sf):
    return rounded(gps.calculate_transition_time(fx.places(spark, sf), ["customer"]))


def _metrics_sql(keys: str) -> str:
    return f"""h AS (SELECT *, 0 AS home, CAST(ts AS DATE) AS day FROM places),
    t AS (SELECT *, coalesce((epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6, 0) AS s, coalesce({_hav('lat', 'lon', 'lead(lat) OVER w', 'lead(lon) OVER w')}, 0) AS m FROM h WINDOW w AS (PARTITION BY {keys} ORDER BY ts)),
    pt AS (SELECT {keys}, lat, lon, sum(s) AS s, count(*) AS c FROM t GROUP BY ALL),
    pp AS (SELECT *, s / nullif(sum(s) OVER (PARTITION BY {keys}), 0) AS p FROM pt),
    pe AS (SELECT {keys}, CASE WHEN sum(c) > 1 THEN sum(-(CASE WHEN p = 0 THEN 1e-10 ELSE p END) * ln(CASE WHEN p = 0 THEN 1e-10 ELSE p END)) END AS e, count(*) AS k FROM pp GROUP BY ALL),
    su AS (SELECT {keys}, sum(m) AS dist, coalesce(100 * sum(CASE WHEN cluster = home THEN s ELSE 0 END) / nullif(sum(s), 0), 0) AS ph, count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS u, count(DISTINCT cluster) AS a FROM t GROUP BY ALL)
    SELECT {{cols}} FROM su JOIN pe USING ({keys})"""


_COLS = "round(CASE WHEN u > 0 THEN e END, 6) AS entropy, round(CASE WHEN u > 0 THEN e / (ln(k) + 1e-9) END, 4) AS normalized_entropy, round(CASE WHEN u > 0 THEN dist ELSE 0 END, 3) AS total_distance, round(CASE WHEN u > 0 THEN ph END, 6) AS percentage_time_at_home, u AS num_unique_clusters, CASE WHEN u > 0 THEN a ELSE 0 END AS num_total_clusters"


@query("a17_mobility_metrics", with_tables(_metrics_sql("customer").format(cols="customer, " + _COLS), "places"))
def _(spark, sf):
    df = gps.calculate_metrics(fx.places(spark, sf).withColumn("home", F.lit(0)), ["customer"])
    return rounded(df.withColumns({"total_distance": F.round("total_distance", 3), "normalized_entropy": F.round("normalized_entropy", 4)}))


_METRICS = ("entropy", "normalized_entropy", "total_distance", "percentage_time_at_home", "num_unique_clusters", "num_total_clusters")
_DAYS, _WHOLE = (f"SELECT * FROM ({with_tables(_metrics_sql(k).format(cols=k + ', ' + _COLS), 'places')})" for k in ("customer, day", "customer"))


@query("a17_j13_daily_and_total", f"SELECT customer, strftime(day, '%Y-%m-%d') AS day, {', '.join(f'd.{m} AS {m}_daily, t.{m} AS {m}_total' for m in _METRICS)} FROM ({_DAYS}) d JOIN ({_WHOLE}) t USING (customer)")
def _(spark, sf):
    df = gps.daily_and_total(fx.places(spark, sf).withColumn("home", F.lit(0)))
    digits = {"total_distance": 3, "normalized_entropy": 4}
    return df.select("customer", F.col("day").cast("string").alias("day"), *[F.round(f"{m}{s}", digits.get(m, 6)).alias(f"{m}{s}") for m in _METRICS for s in ("_daily", "_total")])


@query("a18_raw_location_entropy", with_tables("""s AS (SELECT customer, min(lat) AS a0, max(lat) AS a1, min(lon) AS o0, max(lon) AS o1 FROM places GROUP BY 1),
    c AS (SELECT customer, coalesce(least(10, greatest(1, ceil((lat - a0) * 10 / nullif(a1 - a0, 0)))), 1) AS a, coalesce(least(10, greatest(1, ceil((lon - o0) * 10 / nullif(o1 - o0, 0)))), 1) AS o, count(*) AS n FROM places JOIN s USING (customer) GROUP BY ALL)
    SELECT customer, abs(round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6)) AS raw_entropy FROM c GROUP BY 1""", "places"))  # fmt: skip
def _(spark, sf):
    return gps.raw_location_entropy(fx.places(spark, sf), ["customer"]).select("customer", F.abs(r6("raw_entropy")).alias("raw_entropy"))


@query("w3_time_spent", with_tables("SELECT customer, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, round(coalesce((epoch_us(lead(ts) OVER (PARTITION BY customer ORDER BY ts)) - epoch_us(ts)) / 1e6, 0), 6) AS time_spent FROM places", "places"))
def _(spark, sf):
    return gps.time_spent(fx.places(spark, sf), ["customer"]).select("customer", stamp("startTimestamp").alias("at"), r6("time_spent").alias("time_spent"))


@query("w9_gps_quality_gate", with_tables("d AS (SELECT customer, CAST(ts AS DATE) AS day, count(DISTINCT hour(ts)) AS n_hours FROM places GROUP BY 1, 2 HAVING count(DISTINCT hour(ts)) >= 1), c AS (SELECT customer, count(*) AS n_days FROM d GROUP BY 1 HAVING count(*) >= 9) SELECT customer, strftime(day, '%Y-%m-%d') AS day, n_hours, n_days, count(*) AS n FROM places p JOIN d ON d.customer = p.customer AND d.day = CAST(p.ts AS DATE) JOIN c ON c.customer = p.customer GROUP BY ALL".replace("SELECT customer, strftime(day", "SELECT p.customer, strftime(day"), "places"))
def _(spark, sf):
    df = gps.gps_quality_gate(fx.places(spark, sf), 1, 9)
    return df.groupBy("customer", F.col("day").cast("string").alias("day"), "n_hours", "n_days").agg(F.count("*").alias("n"))


_DAILY_STEPS = "SELECT customer, strftime(CAST(start AS DATE), '%Y-%m-%d') AS day, round(sum(dv), 4) AS n_steps FROM sensor WHERE type = 'Steps' GROUP BY 1, 2"


@query("a27_daily_steps", with_tables(_DAILY_STEPS, "sensor"))
def _(spark, sf):
    return gps.daily_steps(fx.sensor(spark, sf)).select("customer", F.col("day").cast("string").alias("day"), F.round("n_steps", 4).alias("n_steps"))


@query("j15_steps_to_gps_day", with_tables(f"s AS ({_DAILY_STEPS}), g AS (SELECT customer, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS n_points FROM places GROUP BY 1, 2) SELECT * FROM g JOIN s USING (customer, day)", "sensor", "places"))
def _(spark, sf):
    days = fx.places(spark, sf).groupBy("customer", F.to_date("startTimestamp").alias("day")).agg(F.count("*").alias("n_points"))
    df = gps.steps_to_gps_day(days, gps.daily_steps(fx.sensor(spark, sf)))
    return df.withColumns({"day": F.col("day").cast("string"), "n_steps": F.round("n_steps", 4)})


# -- availability ------------------------------------------------------------

_HOURLY = "hourly AS (SELECT customer, type, CAST(start AS DATE) AS day, hour(start) AS hour, max(CASE WHEN type IN ('Latitude', 'Longitude', 'Steps') THEN dv IS NOT NULL ELSE lv IS NOT NULL END) AS available FROM sensor GROUP BY ALL)"
_DAILY = _HOURLY + ", daily AS (SELECT customer, type, day, CAST(max(CAST(available AS INT)) AS INT) AS available_binary, CAST(sum(CAST(available AS INT)) AS BIGINT) AS available_hours FROM hourly GROUP BY ALL)"


@query("a4_hourly_presence", with_tables(_HOURLY + " SELECT customer, type, strftime(day, '%Y-%m-%d') AS day, CAST(hour AS INT) AS hour, available FROM hourly", "sensor"))
def _(spark, sf):
    return av.hourly_presence(fx.sensor(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query("a5_daily_availability", with_tables(_DAILY + " SELECT customer, type, strftime(day, '%Y-%m-%d') AS day, available_binary, available_hours FROM daily", "sensor"))
def _(spark, sf):
    return av.daily_availability(av.hourly_presence(fx.sensor(spark, sf))).withColumn("day", F.col("day").cast("string"))


@query("j11_densify_days", with_tables(_DAILY + """, last AS (SELECT customer, max(day) AS last FROM daily GROUP BY 1),
    grid AS (SELECT t.customer, t.type, CAST(unnest(generate_series(r.ema_base_start, l.last, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT customer, type FROM daily) t JOIN roster r USING (customer) JOIN last l USING (customer) WHERE r.ema_base_start <= l.last)
    SELECT g.customer, g.type, strftime(g.day, '%Y-%m-%d') AS day, coalesce(available_binary, 0) AS available_binary, coalesce(available_hours, 0) AS available_hours, CAST(g.day - r.ema_base_start + 1 AS INT) AS relative_day FROM grid g LEFT JOIN daily d ON d.customer = g.customer AND d.type = g.type AND d.day = g.day JOIN roster r ON r.customer = g.customer
    UNION ALL SELECT d.customer, d.type, strftime(d.day, '%Y-%m-%d'), available_binary, available_hours, NULL FROM daily d WHERE d.customer NOT IN (SELECT customer FROM roster)""", "sensor", "roster"))  # fmt: skip
def _(spark, sf):
    from .pipelines import adherence

    bounds = fx.roster(spark, sf).select("customer", F.col("ema_base_start").alias("base_start"))
    return adherence(fx.sensor(spark, sf), bounds).drop("base_start").withColumn("day", F.col("day").cast("string"))


@query("a3_data_coverage", with_tables("""d AS (SELECT customer, min(CAST(start AS DATE)) AS f, count(DISTINCT CASE WHEN type = 'Latitude' THEN CAST(start AS DATE) END) AS g, count(DISTINCT CASE WHEN type = 'HeartRate' THEN CAST(start AS DATE) END) AS h FROM sensor GROUP BY 1),
    p AS (SELECT d.*, CASE WHEN status = 'Abgeschlossen' AND study_version IN ('Kurz', 'Kurz (Wechsel/Abbruch)') THEN ema_base_end - f ELSE DATE '2024-01-31' - f END AS pot FROM d LEFT JOIN roster USING (customer))
    SELECT customer, CAST(pot AS INT) AS potential_days_coverage, g AS gps_actual_days_with_data, round(100.0 * g / nullif(pot, 0), 6) AS gps_data_coverage_per, h AS hr_actual_days_with_data, round(100.0 * h / nullif(pot, 0), 6) AS hr_data_coverage_per FROM p""", "sensor", "roster"))  # fmt: skip
def _(spark, sf):
    df = av.calculate_data_coverage(fx.sensor(spark, sf), fx.roster(spark, sf), TODAY, {"gps": ["Latitude"], "hr": ["HeartRate"]})
    return rounded(df.select("customer", "potential_days_coverage", "gps_actual_days_with_data", "gps_data_coverage_per", "hr_actual_days_with_data", "hr_data_coverage_per"))


@query("a1_last_seen", with_tables("SELECT customer, strftime(max(start), '%Y-%m-%d %H:%M:%S') AS last_gps FROM sensor WHERE type IN ('Latitude', 'Longitude') GROUP BY 1", "sensor"))
def _(spark, sf):
    return av.last_seen(fx.sensor(spark, sf), ["Latitude", "Longitude"], "t").select("customer", stamp("t").alias("last_gps"))


# -- monitoring --------------------------------------------------------------


def _compliance(spark, sf):
    s = fx.sensor(spark, sf)
    own = fx.roster(spark, sf).withColumn("for_id", F.trim("for_id"))
    counts = ema.session_counts(fx.sessions(spark, sf))
    return monitoring.compliance_table(own, av.last_seen(s, ["HeartRate"], "last_day_passive"), av.last_seen(s, ["Latitude"], "last_day_GPS"), counts)


_COMPLIANCE = """g AS (SELECT customer, max(start) AS last_gps FROM sensor WHERE type = 'Latitude' GROUP BY 1), p AS (SELECT customer, max(start) AS last_passive FROM sensor WHERE type = 'HeartRate' GROUP BY 1),
    n AS (SELECT customer, count_if(study IN (24, 25) AND quest_create IS NOT NULL) AS n0, count_if(study IN (33, 34) AND quest_create IS NOT NULL) AS n1, count_if(study IN (38, 39) AND quest_create IS NOT NULL) AS n2 FROM sessions GROUP BY 1),
    t AS (SELECT customer, trim(for_id) AS for_id, last_gps, last_passive, n0, n1, n2 FROM p FULL JOIN roster USING (customer) FULL JOIN n USING (customer) FULL JOIN g USING (customer) WHERE status IN ('Erhebung_1_aktiv', 'Post_Erhebung_1', 'Erhebung_2_aktiv', 'Post_Erhebung_2', 'Erhebung_3_aktiv')) """


@query("m1_j4_compliance_table", with_tables(_COMPLIANCE + "SELECT customer, for_id, strftime(last_gps, '%Y-%m-%d %H:%M:%S') AS last_gps, strftime(last_passive, '%Y-%m-%d %H:%M:%S') AS last_passive, n0, n1, n2 FROM t", "sensor", "roster", "sessions"))
def _(spark, sf):
    return _compliance(spark, sf).select("customer", "for_id", stamp("last_day_GPS").alias("last_gps"), stamp("last_day_passive").alias("last_passive"), *[F.col(f"n_sessions_phase{i}").alias(f"n{i}") for i in (0, 1, 2)])


_CATEGORY = "c AS (SELECT customer, for_id, CASE WHEN last_gps > DATE '2024-01-29' AND last_passive < DATE '2024-01-29' THEN 'no_pd' WHEN last_gps < DATE '2024-01-29' AND last_passive > DATE '2024-01-29' THEN 'no_gps' WHEN last_gps < DATE '2024-01-29' AND last_passive < DATE '2024-01-29' THEN 'no_gpspd' WHEN last_gps IS NULL THEN 'no_gps_at_all' END AS category FROM t) "


def _interruptions(spark, sf):
    import datetime

    return monitoring.interruptions(_compliance(spark, sf), datetime.date(2024, 1, 29))


@query("m2_interruptions", with_tables(_COMPLIANCE.rstrip() + ", " + _CATEGORY + "SELECT * FROM c WHERE category IS NOT NULL", "sensor", "roster", "sessions"))
def _(spark, sf):
    return _interruptions(spark, sf)


@query("m3_alert_rows", with_tables(_COMPLIANCE.rstrip() + ", " + _CATEGORY + "SELECT '2024-01-31' AS \"Datum\", " + ", ".join(f"CASE WHEN category = '{x}' THEN for_id END AS {x}" for x in ("no_pd", "no_gps", "no_gpspd", "no_gps_at_all")) + " FROM c WHERE category IS NOT NULL", "sensor", "roster", "sessions"))
def _(spark, sf):
    return monitoring.alert_rows(_interruptions(spark, sf), TODAY).withColumn("Datum", F.col("Datum").cast("string"))


def _dates(spark, sf):
    """Roster with all six phase dates and the first call, spread over three weeks."""
    r = fx.roster(spark, sf).withColumn("for_id", F.trim("for_id"))
    n = F.regexp_extract("customer", r"(\d+)", 1).cast("int")
    at = lambda k: F.date_add(F.lit("2024-01-08").cast("date"), (n * k) % 21)
    return r.withColumns({"first_call_date": at(1), "ema_t20_start": at(2), "ema_t20_end": at(5), "ema_post_start": at(8), "ema_post_end": at(11)})


_RULES = " UNION ALL ".join(
    f"SELECT for_id, '{name}' AS task, CAST({day} - DATE '2024-01-15' AS INT) AS day FROM d WHERE {test}"
    for name, day, test in (
        ("onboarding", "dt(n, 1)", "true"), ("baseline_end_long", "ema_base_end + 1", "study_version IN ('Lang', 'Lang(Wechsel)')"), ("t20_start", "dt(n, 2)", "true"),
        ("t20_end", "dt(n, 5) + 1", "true"), ("short_ends_today", "ema_base_end", "study_version LIKE 'Kurz%'"), ("short_end", "ema_base_end + 1", "study_version LIKE 'Kurz%'"),
        ("long_finished", "dt(n, 5) + 1", "t20_post LIKE '%ja%'"), ("post_start", "dt(n, 8)", "true"), ("post_end", "dt(n, 11) + 1", "true"),
    )
)
for _k in (1, 2, 5, 8, 11):
    _RULES = _RULES.replace(f"dt(n, {_k})", f"(DATE '2024-01-08' + CAST((n * {_k}) % 21 AS INT))")


@query("m4_weekly_tasks", with_tables(f"d AS (SELECT *, trim(roster.for_id) AS for_id2, CAST(substr(customer, 2) AS INT) AS n FROM roster), e AS (SELECT * EXCLUDE (for_id, for_id2), for_id2 AS for_id FROM d), r AS ({_RULES.replace('FROM d', 'FROM e')}), w AS (SELECT * FROM r WHERE day BETWEEN 0 AND 6), a AS (SELECT * FROM w UNION ALL SELECT for_id, CASE WHEN day = 5 THEN 'saturday: ' ELSE 'sunday: ' END || task, 0 FROM w WHERE day >= 5) SELECT day, task, string_agg(for_id, ',' ORDER BY for_id) AS ids FROM a GROUP BY 1, 2", "roster"))
def _(spark, sf):
    import datetime

    return monitoring.weekly_tasks(_dates(spark, sf), datetime.date(2024, 1, 15))


# -- missingness -------------------------------------------------------------


def _features(spark, sf):
    """A small feature table with sentinels, from event numbers."""
    e = fx.events(spark, sf)
    own = lambda m, v: F.when(F.col("id") % m == 0, -1.0).otherwise(v)
    cols = {"n_GPS": own(2, F.col("k")), "n_steps": own(3, F.col("k") * 12), "hr_mean": own(5, F.col("k")), "at_home_minute": own(2, F.col("k"))}
    cols |= {c: own(4, F.col("k")) for c in quality.ACTIVITY}
    return e.withColumns({k: v.cast("double") for k, v in cols.items()}).withColumn("age", F.when(F.col("k") != 7, F.col("k")))


_FEAT = "f AS (SELECT *, CASE WHEN id % 2 = 0 THEN -1 ELSE k END AS n_GPS, CASE WHEN id % 3 = 0 THEN -1 ELSE k * 12 END AS n_steps, CASE WHEN id % 5 = 0 THEN -1 ELSE k END AS hr_mean, CASE WHEN id % 4 = 0 THEN -1 ELSE k END AS act, CASE WHEN k <> 7 THEN k END AS age FROM ev) "


@query("p23_drop_all_missing", with_tables(_FEAT + "SELECT count(*) AS n FROM f WHERE NOT (n_GPS = -1 AND n_steps = -1 AND hr_mean = -1)"))
def _(spark, sf):
    return quality.drop_all_missing(_features(spark, sf), ["n_GPS", "n_steps", "hr_mean"]).agg(F.count("*").alias("n"))


@query("p25_missing_gps", with_tables(_FEAT + "SELECT CASE WHEN n_GPS = -1 AND n_steps > 625 THEN 'Steps>625' WHEN n_GPS = -1 THEN 'Steps<=625' ELSE 'GPS_present' END AS \"missing_GPS\", count(*) AS n FROM f GROUP BY 1"))
def _(spark, sf):
    return relational.count_by(quality.classify_missing_gps(_features(spark, sf)), "missing_GPS")


@query("p26_missing_steps", with_tables(_FEAT + "SELECT CASE WHEN n_steps = -1 AND hr_mean = -1 AND act = -1 THEN 'step_missing' WHEN n_steps = -1 THEN 'step_zero' ELSE 'not_missing' END AS missing_steps, count(*) AS n FROM f GROUP BY 1"))
def _(spark, sf):
    return relational.count_by(quality.classify_missing_steps(_features(spark, sf)), "missing_steps")


@query("p27_missing_pa", with_tables(_FEAT + "SELECT CASE WHEN act <> -1 THEN 'not_missing' WHEN n_steps = -1 AND hr_mean = -1 THEN 'pa_missing' ELSE 'pa_zero' END AS missing_pa, count(*) AS n FROM f GROUP BY 1"))
def _(spark, sf):
    return relational.count_by(quality.classify_missing_pa(_features(spark, sf)), "missing_pa")


@query("p28_missing_hr", with_tables(_FEAT + "SELECT CASE WHEN hr_mean = -1 THEN 'hr_missing' ELSE 'not_missing' END AS missing_hr, count(*) AS n FROM f GROUP BY 1"))
def _(spark, sf):
    return relational.count_by(quality.classify_missing_hr(_features(spark, sf)), "missing_hr")


@query("a23_implausible_beeps", with_tables(_FEAT + "SELECT customer, count(*) AS n_blocks, count_if(id % 2 = 0 AND n_steps > 625) AS n_implausible, round(count_if(id % 2 = 0 AND n_steps > 625) / count(*), 6) AS share, count_if(id % 2 = 0 AND n_steps > 625) / count(*) > 0.2 AS implausible FROM f GROUP BY 1"))
def _(spark, sf):
    return rounded(quality.implausible_beeps(_features(spark, sf), ratio=0.2))


@query("a24_missing_flags", with_tables(_FEAT + ", g AS (SELECT *, CASE WHEN act = -1 THEN 1 ELSE 0 END AS pa, CASE WHEN n_GPS = -1 THEN 1 ELSE 0 END AS gp, max(CASE WHEN age IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY customer) AS ps FROM f) SELECT customer, CAST(sum(pa) AS BIGINT) AS missing_pa, CAST(sum(gp) AS BIGINT) AS missing_gps, CAST(sum(ps) AS BIGINT) AS missing_static FROM g GROUP BY 1"))
def _(spark, sf):
    df = quality.missing_flags(_features(spark, sf), {"pa": quality.ACTIVITY, "gps": ["n_GPS"]}, ["age"])
    return df.groupBy("customer").agg(F.sum("missing_pa").alias("missing_pa"), F.sum("missing_gps").alias("missing_gps"), F.sum("missing_person_static").alias("missing_static"))


@query("a24_summarize_missing_data", with_tables(_FEAT + "SELECT 'n_GPS' AS feature, count_if(n_GPS = -1) AS missing, round(100.0 * count_if(n_GPS = -1) / count(*), 6) AS percent FROM f UNION ALL SELECT 'hr_mean', count_if(hr_mean = -1), round(100.0 * count_if(hr_mean = -1) / count(*), 6) FROM f UNION ALL SELECT 'age', count(DISTINCT CASE WHEN age IS NULL THEN customer END), round(100.0 * count(DISTINCT CASE WHEN age IS NULL THEN customer END) / count(DISTINCT customer), 6) FROM f"))
def _(spark, sf):
    return rounded(quality.summarize_missing_data(_features(spark, sf), ["n_GPS", "hr_mean"], ["age"]))

