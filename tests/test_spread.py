"""Work on participants of any size: clusters, graphs, neighbours and joins."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsegrid.operators import density, gps, graphs, spread, tracks

TRACK = "customer string, startTimestamp timestamp, Latitude double, Longitude double"
T0 = datetime.datetime(2024, 1, 1)


def tracks_of(seed):
    rng, rows = np.random.default_rng(seed), []

    def add(name, points):
        rows.extend((name, T0 + datetime.timedelta(minutes=i), float(a), float(b)) for i, (a, b) in enumerate(points))

    add("walk", np.cumsum(rng.normal(0, 0.0004, (900, 2)), 0) + [52.5, 13.4])
    add("blobs", np.concatenate([rng.normal(0, 0.0006, (200, 2)) + [52.5 + 0.003 * i, 13.4] for i in range(4)])[rng.permutation(800)])
    add("date line", np.c_[rng.normal(10, 0.0006, 300), ((rng.normal(180, 0.0008, 300) + 180) % 360) - 180])
    add("pole", np.c_[90 - np.abs(rng.normal(0, 0.0006, 200)), rng.uniform(-180, 180, 200)])
    add("south", np.c_[rng.normal(-33, 0.001, 300), rng.normal(-70, 0.001, 300)])
    add("few", np.full((20, 2), [52.5, 13.4]))
    add("still", np.full((300, 2), [52.5, 13.4]))
    add(None, rng.normal(0, 0.0004, (100, 2)) + [52.5, 13.4])
    add("scattered", rng.uniform(0, 0.02, (500, 2)) + [52.5, 13.4])
    return rows + [("walk", T0, None, 13.4), ("walk", T0, float("nan"), 13.4), ("none", T0, None, None)]


@pytest.mark.parametrize("seed, eps, least, share, heavy", [(0, 100, 10, None, False), (1, 60, 4, None, True), (2, 100, 10, 0.02, True)])
def test_spread_dbscan_equals_the_grouped_one(spark, monkeypatch, seed, eps, least, share, heavy):
    if heavy:  # cells, participants and places with few rows are dealt out as well
        monkeypatch.setattr(spread, "LEAST", 20)
    table = spark.createDataFrame(tracks_of(seed), TRACK)
    got = density.spread_dbscan(table, eps, least, 50, share).toPandas()
    assert len(got) == table.count()
    for _, own in got.groupby("customer", dropna=False):
        own = own.sort_values(["startTimestamp", "Latitude", "Longitude"])
        known, want = (own.Latitude.notna() & own.Longitude.notna()).to_numpy(), np.full(len(own), -1)
        if known.sum() >= 50:
            n = least if share is None else max(2, int(len(own) * share))
            want[known] = gps.density_labels(own.Latitude.to_numpy()[known], own.Longitude.to_numpy()[known], eps, n)
        assert (own.cluster.to_numpy() == want).all()


def test_cells_beside_are_found_by_dealing_few_rows(spark):
    """Some 26 rows a cell, all places around it, were dealt before."""
    rng, metre = np.random.default_rng(5), 1 / 111_194.9
    at = rng.uniform(0, 900 * metre, (400, 2)) + np.repeat([[52.5, 13.4], [-0.004, 179.999]], 200, 0)
    at[:, 1] = (at[:, 1] + 180) % 360 - 180
    cells = density._Cells(60)
    points = spark.createDataFrame([("c", float(a), float(b)) for a, b in at], "customer string, lat double, lon double")
    row, col = cells.of("lat", "lon")
    points = points.withColumn("box", F.struct("customer", row.alias("row"), col.alias("col")))
    grid = points.select("box").distinct().withColumn("cell", F.monotonically_increasing_id()).localCheckpoint()
    assert cells.asked(cells.placed(grid)).count() <= 4 * grid.count()
    pairs = [tuple(r) for r in cells.beside(grid).collect()]
    assert len(pairs) == len(set(pairs)) and {(b, a) for a, b in pairs} == set(pairs)
    own = [r.cell for r in points.join(grid, "box").orderBy("lat", "lon").select("cell").collect()]
    at = at[np.lexsort((at[:, 1], at[:, 0]))]
    metres = gps._metres(at[:, None, 0], at[:, None, 1], at[None, :, 0], at[None, :, 1])
    assert {(own[i], own[j]) for i, j in zip(*np.nonzero(metres <= 60)) if own[i] != own[j]} <= set(pairs)


def test_clusters_that_only_inner_points_join(spark):
    """Two cells whose outermost points are far apart and one pair of others is near."""
    metre = 1 / 111_194.9
    rows = [(0, 0)] * 6 + [(60, 30)] * 6 + [(62, 131)] * 6 + [(0, 158)] * 6 + [(30, 60)] * 6
    table = spark.createDataFrame([("c", T0 + datetime.timedelta(minutes=i), a * metre, b * metre) for i, (a, b) in enumerate(rows)], TRACK)
    got = density.spread_dbscan(table, 100.5, 5, 5).toPandas().sort_values("startTimestamp")
    assert got.cluster.tolist() == gps.density_labels(got.Latitude.to_numpy(), got.Longitude.to_numpy(), 100.5, 5).tolist()


def test_large_and_small_participants_together(spark):
    table = spark.createDataFrame([r for r in tracks_of(3) if r[2] == r[2]], TRACK)  # pandas has no NaN beside null
    key = lambda df: sorted(df.collect(), key=str)
    assert key(gps.dbscan(table, in_one_task=250)) == key(gps.dbscan(table))
    options = {"min_samples": 5, "min_nights_obs": 1}
    assert key(gps.extract_home(table.dropna(), in_one_task=250, **options)) == key(gps.extract_home(table.dropna(), **options))


def test_a_participant_with_most_rows_is_spread(spark, monkeypatch):
    monkeypatch.setattr(spread, "LEAST", 100)
    rows = [("hot", T0 + datetime.timedelta(seconds=i), 52.5, 13.4) for i in range(3000)] + [(f"c{i % 9}", T0 + datetime.timedelta(seconds=i), 52.5, 13.4) for i in range(300)]
    table = spark.createDataFrame(rows, TRACK).repartition(4)
    got = density.spread_dbscan(table, 100, 10, 20).withColumn("task", F.spark_partition_id())
    most = got.groupBy("task").count().agg(F.max("count")).first()[0]
    assert got.where("cluster = 0").count() == 3300 and most < 2000


def test_connected_equals_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.root for r in graphs.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert graphs.connected(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_neighbours_equal_the_window(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), T0 + datetime.timedelta(hours=7 * i), rng.choice([None, float(i)]), i) for i in range(120)]
    rows += [("lone", T0, 1.0, 500), ("a", None, 2.0, 501)]
    df = spark.createDataFrame(rows, "customer string, t timestamp, v double, id long")
    w = Window.partitionBy("customer").orderBy("t", "id")
    names = {"before_v": F.lag("v"), "before_id": F.lag("id"), "after_v": F.lead("v"), "after_t": F.lead("t")}
    want = df.withColumns({n: c.over(w) for n, c in names.items()})
    for segment in (None, F.date_trunc("month", "t"), F.date_trunc("hour", "t")):
        got = tracks.with_neighbours(df, ["customer"], ["t", "id"], ["v", "id"], ["v", "t"], segment)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_neighbours_of_equal_times_agree(spark):
    df = spark.createDataFrame([("a", T0 + datetime.timedelta(days=i // 4), i) for i in range(40)], "customer string, t timestamp, id long")
    got = tracks.with_neighbours(df, ["customer"], ["t"], ["id"], ["id"], F.col("t")).collect()
    follows = {r.id: r.after_id for r in got}
    assert sorted(x for x in follows.values() if x is not None) == sorted(set(range(40)) - {r.id for r in got if r.before_id is None})
    assert all(follows[r.before_id] == r.id for r in got if r.before_id is not None)


@pytest.mark.parametrize("n", [1, 3, 5, 8])
def test_places_and_tiles_equal_the_window(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice(["a", "b", None]), T0 + datetime.timedelta(hours=5 * (i // 3)), i) for i in range(150)] + [("c", T0, 900), ("c", None, 901)]
    df = spark.createDataFrame(rows, "customer string, t timestamp, id long")
    w = Window.partitionBy("customer").orderBy("t", "id")
    want = df.withColumns({"place": F.row_number().over(w), "tile": F.ntile(n).over(w), "of": F.count("*").over(Window.partitionBy("customer")), "total": F.sum("id").over(Window.partitionBy("customer"))})
    for segment in (None, F.col("t")):
        got = tracks.with_totals(tracks.with_place(df, ["customer"], ["t", "id"], segment), ["customer"], {"total": (F.sum, F.col("id"))}, F.col("id") % 5).withColumn("tile", tracks.tile(n))
        assert sorted(map(str, got.select(*[F.col(c).cast("string") for c in want.columns]).collect())) == sorted(map(str, want.select(*[F.col(c).cast("string") for c in want.columns]).collect()))


def test_a_user_is_split_over_tasks(spark):
    """No task holds the rows of a user who has them all."""
    df = spark.range(4000).selectExpr("'hot' customer", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, id, 0, 0) t", "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = tracks.with_place(df, ["customer"], ["t"]).withColumn("task", F.spark_partition_id())
        assert got.groupBy("task").count().agg(F.max("count")).first()[0] < 2500 and got.where("place = id + 1 and of = 4000").count() == 4000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_spread_join_equals_join(spark, monkeypatch):
    monkeypatch.setattr(spread, "LEAST", 10)
    many = spark.createDataFrame([(i % 7 if i % 2 else 0, i) for i in range(400)], "k long, v long")
    few = spark.createDataFrame([(k, f"x{k}") for k in range(5)], "k long, x string")
    heavy = spread.heavy_keys(many.groupBy("k").agg(F.count("*").alias("n")), "n")
    for how in ("inner", "left"):
        assert sorted(map(str, spread.spread_join(many, few, ["k"], heavy, ["v"], how).collect())) == sorted(map(str, many.join(few, "k", how).collect()))
