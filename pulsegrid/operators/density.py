"""DBSCAN of tracks of any size, as joins of grid cells.

A cell is so small that its points all lie within ``eps_m`` of each other.  So a cell
with enough points is core throughout, the core points of a cell are one cluster, and
a cell that is not full has fewer points than a core point needs.  Then

1. points of full cells are core; the few of other cells look around: each meets the
   points of the cells beside its own, at most some 24 times as many rows as there
   are points times the neighbours asked for,
2. clusters are the connected components of the cells with core points.  Two cells
   are joined if core points at their edges are near; cells that this leaves open, in
   different components, are compared point by point, by parts of cells that can
   reach each other,
3. other points take the first cluster that they reach.

Rows are dealt by cell, and cells with a large share of all points to many tasks, so
that no task holds a participant.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import EARTH_RADIUS_M, haversine
from .graphs import connected
from .spread import heavy_keys, spread_join, written

#: Cells are cut into so many parts each way where they are compared point by point.
CUTS = 8
#: Rows and columns of cells in a tile, in which cells meet those beside them.
TILE = 8
#: Degrees from -180 to 360 hold all ways to write a longitude.
TURNS = (-360.0, 0.0, 360.0)
_SURE = 1 + 1e-9


class _Cells:
    """Rows and columns of cells in degrees.  A row's cells are as wide as the size
    allows where it is nearest the equator."""

    def __init__(self, eps_m: float) -> None:
        self.eps_m = eps_m
        self.sine = math.sin(min(math.pi / 2, eps_m / (2 * EARTH_RADIUS_M)))
        self.step = math.degrees(2 * self.sine) / math.sqrt(2) * (1 - 1e-9)

    def width(self, row: Column) -> Column:
        low = F.when(row >= 0, row).otherwise(-row - 1) * self.step
        return F.lit(self.step) / F.cos(F.radians(F.least(low, F.lit(89.999))))

    def of(self, lat: str, lon: str) -> tuple[Column, Column]:
        row = F.floor(F.col(lat) / self.step)
        return row, F.floor(F.col(lon) / self.width(row))

    def _tile(self, customer: Column, tile_row: Column, tile_col: Column) -> Column:
        return F.struct(customer.alias("customer"), tile_row.alias("row"), tile_col.alias("col"))

    def _tile_width(self, tile_row: Column) -> Column:
        return TILE * self.width(tile_row * TILE)

    def placed(self, grid: DataFrame) -> DataFrame:
        """The cells of ``grid`` (cell, box) with their western edge, width and reach."""
        row = F.col("box")["row"]
        high = F.least(F.lit(90.0), F.greatest(F.abs(row - 2), F.abs(row + 3)) * self.step)
        sine = F.lit(self.sine) / F.greatest(F.lit(1e-12), F.cos(F.radians(high)))
        wide = F.greatest(self.width(row - 2), self.width(row + 2))
        reach = F.when(sine >= 1, 360.0).otherwise(2 * F.degrees(F.asin(F.least(sine, F.lit(1.0)))) * _SURE) + wide * 1e-6
        west = F.col("box")["col"] * self.width(row)
        return grid.select("cell", F.col("box")["customer"].alias("customer"), row.alias("row"), west.alias("west"), self.width(row).alias("own"), reach.alias("reach"), wide.alias("wide"))

    def asked(self, placed: DataFrame) -> DataFrame:
        """Each cell (a) with all tiles that its reach meets, some two or three."""
        met = []
        for step in (-2, 2):
            tile_row = F.floor((F.col("row") + step) / TILE)
            width = self._tile_width(tile_row)
            for turn in TURNS:
                west = F.col("west") + turn
                first = F.greatest(F.floor((west - F.col("reach") - F.col("wide")) / width), F.floor(F.lit(-180.0) / width) - 1)
                last = F.least(F.floor((west + F.col("own") + F.col("reach")) / width), F.floor(F.lit(360.0) / width) + 1)
                cols = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
                met.append(F.transform(cols, self._in_row(F.col("customer"), tile_row)))
        return placed.select(F.explode(F.array_distinct(F.concat(*met))).alias("tile"), F.col("cell").alias("a"), "row", "west", "own", "reach")

    def beside(self, grid: DataFrame) -> DataFrame:
        """a, b: the cells that may hold points within reach of each other, both ways.
        A cell lies in one tile and asks in those about it; so what is dealt are cells,
        not all the places around each."""
        placed, at = self.placed(grid), F.floor(F.col("row") / TILE)
        tile = self._tile(F.col("customer"), at, F.floor(F.col("west") / self._tile_width(at)))
        there = placed.select(tile.alias("tile"), F.col("cell").alias("b"), F.col("row").alias("b_row"), F.col("west").alias("b_west"), F.col("own").alias("b_own"))
        gap = lambda turn: F.greatest(F.col("b_west") - F.col("west") - F.col("own") - turn, F.col("west") + turn - F.col("b_west") - F.col("b_own"))
        near = reduce(lambda x, y: x | y, [gap(turn) <= F.col("reach") for turn in TURNS])
        return self.asked(placed).join(there, "tile").where((F.col("a") != F.col("b")) & (F.abs(F.col("row") - F.col("b_row")) <= 2) & near).select("a", "b")

    def _in_row(self, customer: Column, row: Column):
        return lambda col: self._tile(customer, row, col)

    def may_reach(self, a: str, b: str) -> Column:
        """Whether points in the bounds a and b (south, north, west, east) can be near."""
        far = lambda low, high: F.greatest(F.lit(0.0), F.col(f"{a}_{low}") - F.col(f"{b}_{high}"), F.col(f"{b}_{low}") - F.col(f"{a}_{high}"))
        lat, lon = far("south", "north"), far("west", "east")
        lon = F.when(lon > 180, 0.0).otherwise(lon)
        narrow = F.cos(F.radians(F.greatest(*[F.abs(F.col(f"{x}_{y}")) for x in (a, b) for y in ("south", "north")])))
        h = F.pow(F.sin(F.radians(lat) / 2), 2) + F.pow(narrow * F.sin(F.radians(lon) / 2), 2)
        return h <= self.sine**2 * _SURE


def _bounds(prefix: str, lat: str = "lat", lon: str = "lon") -> list[Column]:
    return [f(c).alias(f"{prefix}_{n}") for n, f, c in (("south", F.min, lat), ("north", F.max, lat), ("west", F.min, lon), ("east", F.max, lon))]


def _near(places: DataFrame, probes: DataFrame, heavy: DataFrame | None, eps_m: float) -> DataFrame:
    """Points of ``places`` (cell, lat, lon, ...) within reach of ``probes`` (cell: the
    one looked into, p_lat, p_lon, ...)."""
    met = spread_join(places, probes, ["cell"], heavy, ["lat", "lon"])
    return met.where(haversine("lon", "lat", "p_lon", "p_lat") <= eps_m)


def _joined_cells(core: DataFrame, beside: DataFrame, cells: _Cells, heavy: DataFrame | None) -> DataFrame:
    """cell, root: the cells with core points and the cluster they belong to."""
    at = F.struct("lat", "lon")
    edge = [F.min_by(at, "lat"), F.max_by(at, "lat"), F.min_by(at, "lon"), F.max_by(at, "lon")]
    owned = written(core.groupBy("cell").agg(F.array_distinct(F.array(*edge)).alias("edge"), *_bounds("c")), "core-cells")
    named = lambda p: owned.select(F.col("cell").alias(p), F.col("edge").alias(f"{p}_edge"), *[F.col(f"c_{n}").alias(f"{p}_{n}") for n in ("south", "north", "west", "east")])
    pairs = beside.where("a < b").join(named("a"), "a").join(named("b"), "b").where(cells.may_reach("a", "b"))
    close = lambda x, y: haversine(x["lon"], x["lat"], y["lon"], y["lat"]) <= cells.eps_m
    sure = F.exists("a_edge", lambda x: F.exists("b_edge", lambda y: close(x, y)))
    pairs = written(pairs.withColumn("sure", sure).drop("a_edge", "b_edge"), "cell-pairs")
    grown = connected(pairs.where("sure").select(F.col("a").alias("u"), F.col("b").alias("v")))
    rooted = written(owned.select("cell").join(grown.withColumnRenamed("node", "cell"), "cell", "left").select("cell", F.coalesce("root", "cell").alias("root")), "rooted")
    ends = [rooted.select(F.col("cell").alias(p), F.col("root").alias(f"{p}_root")) for p in ("a", "b")]
    open_ = written(pairs.where("not sure").join(ends[0], "a").join(ends[1], "b").where("a_root != b_root"), "open-pairs")
    if open_.isEmpty():
        return rooted

    def parts(own: str, other: str) -> DataFrame:
        """Core points of a side's cells that may reach the other cell, by part."""
        asked = open_.select("a", "b", F.col(own).alias("cell"), *[F.col(f"{other}_{n}").alias(f"o_{n}") for n in ("south", "north", "west", "east")])
        point = {f"p_{n}": F.col(c) for n, c in (("south", "lat"), ("north", "lat"), ("west", "lon"), ("east", "lon"))}
        met = spread_join(core.select("cell", "lat", "lon"), asked, ["cell"], heavy, ["lat", "lon"]).withColumns(point).where(cells.may_reach("p", "o"))
        cut = F.struct(F.floor(F.col("lat") / (cells.step / CUTS)).alias("row"), F.floor(F.col("lon") / (cells.width(F.floor(F.col("lat") / cells.step)) / CUTS)).alias("col"))
        return written(met.select("a", "b", "lat", "lon", cut.alias(f"{own}_part")), "parts")

    one, two = parts("a", "b"), parts("b", "a")
    sides = [side.groupBy("a", "b", f"{p}_part").agg(*_bounds(p)) for side, p in ((one, "a"), (two, "b"))]
    asked = sides[0].join(sides[1], ["a", "b"]).where(cells.may_reach("a", "b")).select("a", "b", "a_part", "b_part")
    met = one.join(asked, ["a", "b", "a_part"]).join(two.withColumnsRenamed({"lat": "p_lat", "lon": "p_lon"}), ["a", "b", "b_part"])
    found = met.where(haversine("lon", "lat", "p_lon", "p_lat") <= cells.eps_m).select("a", "b").distinct()
    links = open_.select("a", "b", F.col("a_root").alias("u"), F.col("b_root").alias("v")).join(found, ["a", "b"]).select("u", "v").distinct()
    merged = connected(links).select(F.col("node").alias("root"), F.col("root").alias("last"))
    return written(rooted.join(merged, "root", "left").select("cell", F.coalesce("last", "root").alias("root")), "rooted")


def spread_dbscan(gps: DataFrame, eps_m: float, min_samples: int, min_data_points: int, min_share: float | None = None, ts: str = "startTimestamp") -> DataFrame:
    """``gps`` with ``cluster``, as ``gps.dbscan`` has it; clusters are numbered by
    their earliest core point (ties in time: the most southern, then western)."""
    cells = _Cells(eps_m)
    known = ~(F.isnan(F.col("Latitude").cast("double")) | F.isnan(F.col("Longitude").cast("double")))
    known = F.coalesce(known, F.lit(False))
    lat, lon = F.col("Latitude").cast("double"), F.col("Longitude").cast("double")
    rows = gps.where(known).groupBy("customer", lat.alias("lat"), lon.alias("lon")).agg(F.count("*").alias("n"), F.min(ts).alias("first"))
    row, col = cells.of("lat", "lon")
    box = F.struct("customer", row.alias("row"), col.alias("col"))
    points = written(rows.select(box.alias("box"), "lat", "lon", "n", "first"), "points")

    people = gps.groupBy(F.struct("customer").alias("who")).agg(F.count("*").alias("rows"), F.count_if(known).alias("known"))
    least = F.lit(min_samples) if min_share is None else F.greatest(F.lit(2), F.floor(F.col("rows") * min_share))
    people = written(people.where(F.col("known") >= min_data_points).select("who", least.cast("long").alias("least")), "people")
    counted = points.groupBy("box").agg(F.sum("n").alias("in_cell"), F.count("*").alias("size")).withColumn("who", F.struct(F.col("box")["customer"].alias("customer")))
    owners = heavy_keys(written(counted.groupBy("who").agg(F.count("*").alias("size")), "owners"), "size")
    grid = spread_join(counted, people, ["who"], owners, ["box"]).withColumn("full", F.col("in_cell") >= F.col("least")).drop("who")
    grid = written(grid.withColumn("cell", F.monotonically_increasing_id()), "cells")  # from here on cells are numbers
    boxes, heavy = (heavy_keys(grid.select(c, "size"), "size") for c in ("box", "cell"))

    beside = written(cells.beside(grid), "beside")
    placed = spread_join(points, grid.select("box", "cell", "in_cell", "least", "full"), ["box"], boxes, ["lat", "lon"])
    placed = written(placed.withColumn("customer", F.col("box")["customer"]).drop("box"), "placed")
    sparse = placed.where("not full")

    looked = sparse.select(F.col("cell").alias("a"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")).join(beside, "a")
    found = _near(placed.select("cell", "lat", "lon", "n"), looked.withColumnRenamed("b", "cell"), heavy, eps_m)
    counts = found.groupBy(F.col("a").alias("cell"), F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon")).agg(F.sum("n").alias("others"))
    judged = sparse.join(counts, ["cell", "lat", "lon"], "left").withColumn("core", F.col("in_cell") + F.coalesce("others", F.lit(0)) >= F.col("least"))
    kept = ["cell", "customer", "lat", "lon", "n", "first", "full", "core"]
    marked = written(placed.where("full").withColumn("core", F.lit(True)).select(*kept).unionByName(judged.select(*kept)), "marked")
    core = marked.where("core")

    roots = _joined_cells(core, beside, cells, heavy)
    begun = core.groupBy("cell").agg(F.min(F.struct("first", "lat", "lon")).alias("begun"), F.min("customer").alias("customer"))
    begun = begun.join(roots, "cell").groupBy("root").agg(F.min("begun").alias("begun"), F.min("customer").alias("customer"))
    number = F.row_number().over(Window.partitionBy("customer").orderBy("begun")) - 1  # one row a cluster
    labels = written(roots.join(begun.select("root", number.cast("int").alias("cluster")), "root").select("cell", "cluster"), "labels")

    lone = marked.where("not core")
    own = lone.select("cell", "lat", "lon").join(labels, "cell").select("cell", "lat", "lon", "cluster")
    asked = lone.select(F.col("cell").alias("a"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")).join(beside, "a").withColumnRenamed("b", "cell").join(labels, "cell")
    edge = _near(core.select("cell", "lat", "lon"), asked, heavy, eps_m).select(F.col("a").alias("cell"), F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon"), "cluster")
    edge = own.unionByName(edge).groupBy("cell", "lat", "lon").agg(F.min("cluster").alias("cluster"))
    inner = spread_join(core.select("cell", "customer", "lat", "lon", "n"), labels, ["cell"], heavy, ["lat", "lon"])
    done = inner.select("customer", "lat", "lon", "n", "cluster").unionByName(lone.select("cell", "customer", "lat", "lon", "n").join(edge, ["cell", "lat", "lon"]).select("customer", "lat", "lon", "n", "cluster"))
    done = written(done.select(F.struct(F.struct("customer").alias("who"), "lat", "lon").alias("place_"), F.col("cluster").alias("cluster_"), "n"), "clustered")

    repeated = heavy_keys(done.select("place_", "n"), "n")
    tagged = gps.withColumn("place_", F.struct(F.struct("customer").alias("who"), lat.alias("lat"), lon.alias("lon")))
    met = spread_join(tagged, done.select("place_", "cluster_"), ["place_"], repeated, [ts], "left")
    return met.withColumn("cluster", F.coalesce("cluster_", F.lit(-1))).drop("place_", "cluster_")
