"""Places, home location and mobility from GPS tracks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import EARTH_RADIUS_M, compose_ids, haversine, seconds_between
from .density import spread_dbscan
from .spread import heavy_keys, spread_join, written
from .tracks import with_neighbours

NOISE = -1


def pivot_gps(sensor: DataFrame) -> DataFrame:
    """Latitude and Longitude rows as one row per (customer, time); first by value."""
    rows = sensor.where(F.col("type").isin("Latitude", "Longitude"))
    return rows.groupBy("customer", "startTimestamp").pivot("type", ["Latitude", "Longitude"]).agg(F.min("doubleValue"))


def data_quality_check(gps: DataFrame, min_data_points: int = 10) -> DataFrame:
    """Rows of customers with enough points."""
    enough = gps.groupBy("customer").agg(F.count("*").alias("n")).where(F.col("n") >= min_data_points)
    return gps.join(enough, "customer", "left_semi")


def calculate_distances_and_speeds(gps: DataFrame, aligned: bool = False) -> DataFrame:
    """Metres to the next point (last: 0), seconds since the one before (first: 0) and
    their quotient (null for 0 s).  ``aligned``: both to the point before."""
    place, side = ["Longitude", "Latitude"], "before" if aligned else "after"
    rows = with_neighbours(gps, ["customer"], ["startTimestamp"], ["startTimestamp", *(place if aligned else [])], [] if aligned else place)
    metres = haversine("Longitude", "Latitude", f"{side}_Longitude", f"{side}_Latitude")
    seconds = seconds_between(F.col("before_startTimestamp"), F.col("startTimestamp"))
    found = rows.withColumns({"distance": F.coalesce(metres, F.lit(0.0)), "time_diff": F.coalesce(seconds, F.lit(0.0))})
    return found.withColumn("speed", F.try_divide("distance", "time_diff")).select(*gps.columns, "distance", "time_diff", "speed")


def calculate_stationary_and_transition(df: DataFrame, speed_limit: float = 1.4, max_distance: float = 150, max_kmh: float = 220) -> DataFrame:
    """Drops null speeds and those above ``max_kmh``; flags stationary and moving points."""
    sound = df.where(F.col("speed").isNotNull() & (F.col("speed") * 3.6 <= max_kmh))
    still = (F.col("speed") < speed_limit) & (F.col("distance") < max_distance)
    return sound.withColumns({"stationary": still.cast("int"), "transition": (F.col("speed") >= speed_limit).cast("int")})


# -- clusters ----------------------------------------------------------------


def _metres(lat1, lon1, lat2, lon2):
    lat1, lon1, lat2, lon2 = map(np.radians, (lat1, lon1, lat2, lon2))
    a = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


class _Grid:
    """Points in cells whose points all lie within ``eps_m`` of each other.

    A row's cells are as wide as that at its latitude nearest the equator; both bounds
    follow from the haversine formula and hold everywhere on the globe.
    """

    def __init__(self, points: np.ndarray, eps_m: float):
        self.arc = np.sin(min(np.pi / 2, eps_m / (2 * EARTH_RADIUS_M)))
        self.step = np.degrees(2 * self.arc) / np.sqrt(2) * (1 - 1e-9)
        row = np.floor(points[:, 0] / self.step).astype(np.int64)
        col = np.floor(points[:, 1] / self._width(row)).astype(np.int64)
        order = np.lexsort((col, row))
        row, col = row[order], col[order]
        new = np.ones(len(points), bool)
        new[1:] = (row[1:] != row[:-1]) | (col[1:] != col[:-1])
        self.starts = np.flatnonzero(new)
        self.row, self.col, self.order = row[self.starts], col[self.starts], order
        self.members = np.split(order, self.starts[1:])
        self.of = np.empty(len(points), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.ends = np.r_[self.starts[1:], len(points)]
        self.low = min(0, int(self.col.min(initial=0)))
        self.high = int(self.col.max(initial=0)) - self.low + 1
        self.keys = self._key(self.row, self.col)

    def _width(self, row):
        low = np.where(row >= 0, row, -row - 1) * self.step
        return self.step / np.cos(np.radians(np.minimum(low, 89.999)))

    def _key(self, row, col):
        """Orders cells by row and column; columns beyond the last are one past it."""
        return row * (self.high + 1) + np.clip(col - self.low, 0, self.high)

    def around(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (a, b) of ``cells`` and other cells that may hold points within
        ``eps_m`` of each other, as places in ``cells`` and numbers of cells."""
        row, own = self.row[cells], self._width(self.row[cells])
        found = []
        for step in range(-2, 3):
            r = row + step
            high = np.minimum(90.0, np.max(np.abs([r, r + 1, row, row + 1]), axis=0) * self.step)
            sine = self.arc / np.maximum(1e-12, np.cos(np.radians(high)))
            reach = np.where(sine >= 1, 360.0, 2 * np.degrees(np.arcsin(np.minimum(sine, 1.0))) * (1 + 1e-9))
            west, east, width = self.col[cells] * own - reach, (self.col[cells] + 1) * own + reach, self._width(r)
            for turn in (-360.0, 0.0, 360.0):
                first = np.floor((west + turn) / width).astype(np.int64) - 1
                last = np.floor((east + turn) / width).astype(np.int64) + 1
                i = np.searchsorted(self.keys, self._key(r, first))
                j = np.searchsorted(self.keys, self._key(r, last + 1))
                found.append(_ranges(i, np.maximum(i, j)))
        a, b = (np.concatenate(x) for x in zip(*found))
        pairs = np.unique(a * len(self.row) + b)
        a, b = pairs // max(1, len(self.row)), pairs % max(1, len(self.row))
        return a[b != cells[a]], b[b != cells[a]]

    def near(self, points: np.ndarray, asked: np.ndarray, eps_m: float, some: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j): points of ``asked`` (grouped by cell) and all points within ``eps_m``
        of them, themselves included, some millions of candidates at a time."""
        cells = np.unique(self.of[asked])
        a, b = self.around(cells)
        a, b = np.r_[a, np.arange(len(cells))], np.r_[b, cells]
        by = np.argsort(a, kind="stable")
        a, b = a[by], b[by]
        begin = np.searchsorted(a, np.arange(len(cells) + 1))
        place = np.searchsorted(cells, self.of[asked])
        which, pair = _ranges(begin[place], begin[place + 1])  # a point and the cells around it
        size = self.ends[b[pair]] - self.starts[b[pair]]
        upto = np.cumsum(size)
        cuts = np.r_[0, np.searchsorted(upto, np.arange(some, upto[-1] if len(upto) else 0, some)), len(size)]
        for x, y in zip(cuts[:-1], cuts[1:]):
            own, at = _ranges(self.starts[b[pair[x:y]]], self.ends[b[pair[x:y]]])
            i, j = asked[which[x:y][own]], self.order[at]
            close = _metres(points[i, 0], points[i, 1], points[j, 0], points[j, 1]) <= eps_m
            yield i[close], j[close]


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, x) for every x from first[k] to before last[k]."""
    size = last - first
    k = np.repeat(np.arange(len(size)), size)
    return k, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[k]


def _reaching(a: np.ndarray, b: np.ndarray, eps_m: float) -> np.ndarray:
    """Those of ``a`` that may lie within ``eps_m`` of a point in the bounds of ``b``."""
    gap = np.maximum(0, np.maximum(b.min(0) - a, a - b.max(0)))
    turned = np.where(gap[:, 1] > 180, 0, gap[:, 1])
    narrow = np.cos(np.radians(max(np.abs(a[:, 0]).max(), np.abs(b[:, 0]).max())))
    h = np.sin(np.radians(gap[:, 0]) / 2) ** 2 + narrow**2 * np.sin(np.radians(turned) / 2) ** 2
    return a[h <= np.sin(min(np.pi / 2, eps_m / (2 * EARTH_RADIUS_M))) ** 2 * (1 + 1e-9)]


def _touch(a: np.ndarray, b: np.ndarray, eps_m: float) -> bool:
    """Whether a point of ``a`` lies within ``eps_m`` of one of ``b``."""
    close = b[np.argmin(_metres(*a.mean(0), b[:, 0], b[:, 1]))]
    if (_metres(*close, a[:, 0], a[:, 1]) <= eps_m).any():
        return True
    a = _reaching(a, b, eps_m)
    b = _reaching(b, a, eps_m) if len(a) else b[:0]
    few, many = (a, b) if len(a) < len(b) else (b, a)
    return any((_metres(*p, many[:, 0], many[:, 1]) <= eps_m).any() for p in few)


#: Up to so many distinct points, all are compared with each other at once.
FEW = 128


def _few_labels(points: np.ndarray, where: np.ndarray, counts: np.ndarray, eps_m: float, min_samples: int) -> np.ndarray:
    """``density_labels`` of a few distinct points, from the table of their distances."""
    near = _metres(points[:, :1], points[:, 1:], points[:, 0], points[:, 1]) <= eps_m
    core = near @ counts >= min_samples
    labels = np.full(len(points), NOISE)
    begun = np.unique(where, return_index=True)[1]
    linked = near & core
    number = 0
    for p in np.argsort(begun)[core[np.argsort(begun)]]:
        if labels[p] != NOISE:
            continue
        held, grown = 0, linked[p]
        while grown.sum() > held:  # core points reached, until there are no more
            held = grown.sum()
            grown = linked[grown].any(0)
        labels[grown] = number
        number += 1
    edge = np.where(linked, labels, number).min(1)
    return np.where(core, labels, np.where(edge < number, edge, NOISE))


def density_labels(lat: np.ndarray, lon: np.ndarray, eps_m: float, min_samples: int) -> np.ndarray:
    """DBSCAN labels, numbered by the earliest core point; noise -1, and a point that
    several clusters reach belongs to the first.

    Equal points are taken once with their count.  Points of a cell with enough of
    them are core at once, and the core points of a cell are one cluster, so that cells
    are joined instead of points and no neighbours are kept: memory follows the points.
    """
    points, where, counts = np.unique(np.stack([lat, lon], 1), axis=0, return_inverse=True, return_counts=True)
    labels = np.full(len(points), NOISE)
    if not len(points):
        return labels
    where = where.ravel()
    if len(points) <= FEW:
        return _few_labels(points, where, counts, eps_m, min_samples)[where]
    grid = _Grid(points, eps_m)
    full = np.add.reduceat(counts[grid.order], grid.starts) >= min_samples
    core = full[grid.of]
    sparse = np.flatnonzero(~full[grid.of])
    reached = np.zeros(len(points))
    for i, j in grid.near(points, sparse, eps_m):
        reached += np.bincount(i, counts[j], len(points))
    core[sparse] = reached[sparse] >= min_samples
    cores = [own[core[own]] for own in grid.members]
    parent = list(range(len(full)))

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    held = np.flatnonzero([len(own) for own in cores])
    at, other = grid.around(held)
    for c, j in zip(held[at].tolist(), other.tolist()):
        if j > c and len(cores[j]) and root(c) != root(j) and _touch(points[cores[c]], points[cores[j]], eps_m):
            parent[root(j)] = root(c)
    first = np.full(len(points), len(lat))
    np.minimum.at(first, where, np.arange(len(lat)))
    numbers: dict[int, int] = {}
    begun = {c: first[own].min() for c, own in enumerate(cores) if len(own)}
    for c in sorted(begun, key=begun.__getitem__):
        labels[cores[c]] = numbers.setdefault(root(c), len(numbers))
    edge = np.full(len(points), len(numbers))
    for i, j in grid.near(points, np.flatnonzero(~core), eps_m):
        np.minimum.at(edge, i[core[j]], labels[j[core[j]]])
    labels[~core] = np.where(edge < len(numbers), edge, NOISE)[~core]
    return labels[where]


#: Participants with more points than this are clustered by joins over many tasks.
IN_ONE_TASK = 200_000


def large_participants(gps: DataFrame, in_one_task: int = IN_ONE_TASK) -> DataFrame | None:
    """who (a struct of customer) of those with more rows; None if there are none."""
    sizes = gps.groupBy(F.struct("customer").alias("who")).agg(F.count("*").alias("n"))
    found = written(sizes.where(F.col("n") > in_one_task).select("who"), "large")
    return None if found.isEmpty() else found


def dbscan(gps: DataFrame, eps_m: float = 100, min_samples: int = 10, min_data_points: int = 50, min_share: float | None = None, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """Adds ``cluster`` per customer; customers with too few points are all noise.

    ``min_share``: instead of ``min_samples`` this share of the customer's points is
    asked for (rounded down, 2 at least), for phones that send seldom.  A customer's
    points are held by one task if they are ``in_one_task`` at most; those of others
    are clustered by ``density.spread_dbscan``, with the same labels.
    """
    return _clustered(gps, eps_m, min_samples, min_data_points, min_share, large_participants(gps, in_one_task))


def _clustered(gps: DataFrame, eps_m: float, min_samples: int, min_data_points: int, min_share: float | None, large: DataFrame | None) -> DataFrame:
    """``dbscan`` with the participants that are too large for one task known."""
    schema = f"{_schema(gps)}, cluster int"

    def label(rows: pa.Table) -> pa.Table:
        lat, lon = (pc.cast(rows[c], pa.float64()).to_numpy() for c in ("Latitude", "Longitude"))  # null: nan
        order = np.lexsort((lon, lat, pc.fill_null(pc.cast(rows["startTimestamp"], pa.int64()), 2**63 - 1).to_numpy()))
        known = order[~(np.isnan(lat) | np.isnan(lon))[order]]
        labels = np.full(len(lat), NOISE, np.int32)
        if len(known) >= min_data_points:
            least = min_samples if min_share is None else max(2, int(len(lat) * min_share))
            labels[known] = density_labels(lat[known], lon[known], eps_m, least)
        return rows.append_column("cluster", pa.array(labels))

    if large is None:
        return gps.groupBy("customer").applyInArrow(label, schema)
    own = written(gps, "tracks").withColumn("who", F.struct("customer"))
    rest = own.join(large, "who", "left_anti").drop("who").groupBy("customer").applyInArrow(label, schema)
    return rest.unionByName(spread_dbscan(own.join(large, "who", "left_semi").drop("who"), eps_m, min_samples, min_data_points, min_share))


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def growing_kmeans(x: np.ndarray, weights: np.ndarray, d_max: float, max_k: int, rounds: int = 50, chunk: int = 65_536) -> np.ndarray:
    """Labels of points in degrees (distinct, with their counts): the mean of all is the
    first centre, and while a point lies more than ``d_max`` metres from its own, the
    one farthest off becomes one more and Lloyd's rounds go on from there.

    A point keeps a bound on the distance to its own and to the second nearest centre;
    as these follow from how far centres move, few points are compared with all."""
    length = lambda v: np.sqrt((v * v).sum(-1))
    centres = np.average(x, axis=0, weights=weights)[None]
    own, upper, lower = np.zeros(len(x), np.int64), length(x - centres[0]), np.full(len(x), np.inf)
    for k in range(1, max_k + 1):
        metres = _metres(x[:, 0], x[:, 1], centres[own, 0], centres[own, 1])
        far = int(metres.argmax())
        if metres[far] <= d_max or k == min(max_k, len(x)):
            break
        centres = np.vstack([centres, x[far]])
        d = length(x - x[far])
        nearer = d < upper
        lower = np.where(nearer, upper, np.minimum(lower, d))
        own[nearer], upper[nearer] = k, d[nearer]
        for _ in range(rounds):
            total = np.bincount(own, weights, k + 1)
            sums = np.stack([np.bincount(own, weights * x[:, i], k + 1) for i in (0, 1)], 1)
            new = np.where(total[:, None] > 0, sums / np.maximum(total, 1)[:, None], centres)
            moved, centres = length(new - centres), new
            if moved.max() < 1e-12:
                break
            upper, lower = upper + moved[own], lower - moved.max()
            apart = length(centres[:, None] - centres[None])
            np.fill_diagonal(apart, np.inf)
            safe = np.maximum(apart.min(1)[own] / 2, lower)
            doubt = np.flatnonzero(upper > safe)
            upper[doubt] = length(x[doubt] - centres[own[doubt]])
            doubt = doubt[upper[doubt] > safe[doubt]]
            for part in (doubt[i : i + chunk] for i in range(0, len(doubt), chunk)):
                d = np.stack([length(x[part] - c) for c in centres], 1)
                own[part], two = d.argmin(1), np.partition(d, 1, axis=1)
                upper[part], lower[part] = two[:, 0], two[:, 1]
        upper = length(x - centres[own])
    return own


def adaptive_kmeans(gps: DataFrame, d_max: float = 500, max_k: int = 50) -> DataFrame:
    """Adds ``cluster``: the first number of centres, from one on, with which every
    point lies within ``d_max`` metres of its own, or ``max_k`` of them.

    Every row counts: equal points are one with their number as weight, added up before
    a customer's points meet in a task (500,000 distinct ones take 200 MB).  Clusters are
    numbered by their earliest row; rows without coordinates are noise (-1)."""
    lat, lon = F.nanvl(F.col("Latitude").cast("double"), F.lit(None)), F.nanvl(F.col("Longitude").cast("double"), F.lit(None))
    rows = gps.withColumn("place_", F.struct("customer", lat.alias("lat"), lon.alias("lon")))
    points = rows.where("place_.lat IS NOT NULL AND place_.lon IS NOT NULL").groupBy("place_").agg(F.count("*").alias("n"), F.min("startTimestamp").alias("first"))

    def label(rows: pa.Table) -> pa.Table:
        lat, lon, n = (rows[c].to_numpy() for c in ("lat", "lon", "n"))
        rows = rows.take(pa.array(np.lexsort((lon, lat, pc.fill_null(pc.cast(rows["first"], pa.int64()), 2**63 - 1).to_numpy()))))
        lat, lon, n = (rows[c].to_numpy() for c in ("lat", "lon", "n"))
        own = growing_kmeans(np.stack([lat, lon], 1), n.astype(float), d_max, max_k)
        begun = np.sort(np.unique(own, return_index=True)[1])  # numbers by the first row of each
        number = np.zeros(own.max() + 1, np.int32)
        number[own[begun]] = np.arange(len(begun))
        return rows.select(["customer", "lat", "lon", "n"]).append_column("cluster_", pa.array(number[own]))

    customer = gps.schema["customer"].dataType.simpleString()
    found = points.select("place_.*", "n", "first").groupBy("customer").applyInArrow(label, f"customer {customer}, lat double, lon double, n long, cluster_ int")
    found = written(found.select(F.struct("customer", "lat", "lon").alias("place_"), "n", "cluster_"), "kmeans")
    met = spread_join(rows, found.drop("n"), ["place_"], heavy_keys(found.select("place_", "n"), "n"), ["startTimestamp"], "left")
    return met.withColumn("cluster", F.coalesce("cluster_", F.lit(NOISE))).drop("place_", "cluster_")


# -- home --------------------------------------------------------------------


def find_home_cluster(gps: DataFrame, min_nights_obs: int = 4, min_f_home: float = 0.5, literal_f_home: bool = False, strict: bool = False) -> DataFrame:
    """customer, home.  Home is the most frequent cluster of night points (20 to 6 h;
    ties: the smallest), given enough nights and share; else the largest cluster.

    ``literal_f_home``: the share counts as 1, as in the published pipeline.
    ``strict``: nights until 4 h, share above the limit, and no fallback.
    """
    night = _night(strict)
    placed = gps.where(F.col("cluster") != NOISE)
    by_cluster = placed.groupBy("customer", "cluster").agg(F.count("*").alias("n_all"), F.count_if(night).alias("n_night"))
    nights = placed.where(night).groupBy("customer").agg(F.countDistinct(F.to_date("startTimestamp")).alias("nights"), F.count("*").alias("night_obs"))
    best = lambda n: F.max_by("cluster", F.struct(F.col(n), -F.col("cluster")))
    picked = by_cluster.groupBy("customer").agg(
        F.when(F.max("n_night") > 0, best("n_night")).alias("at_night"), F.max("n_night").alias("n_home"), best("n_all").alias("largest")
    )
    home = picked.join(nights, "customer", "left").select("customer", _home(min_nights_obs, min_f_home, literal_f_home, strict).alias("home"))
    return gps.select("customer").distinct().join(home, "customer", "left")


def _night(strict: bool):
    hour = F.hour("startTimestamp")
    return (hour >= 20) | ((hour < 4) if strict else (hour <= 6))


def _home(min_nights_obs: int, min_f_home: float, literal_f_home: bool, strict: bool):
    """Home from at_night, n_home, largest, nights and night_obs."""
    share = F.lit(1.0) if literal_f_home else F.try_divide(F.col("n_home"), F.col("night_obs"))
    enough = (F.col("nights") >= min_nights_obs) & ((share > min_f_home) if strict else (share >= min_f_home))
    return F.when(enough, F.col("at_night")).otherwise(F.lit(None) if strict else F.col("largest"))


def with_home(gps: DataFrame, min_nights_obs: int = 4, min_f_home: float = 0.5, literal_f_home: bool = False, strict: bool = False) -> DataFrame:
    """``gps`` with ``find_home_cluster``'s home, by windows over its rows: they are read
    once, which counts where they come from clustering."""
    placed, night = F.col("cluster") != NOISE, _night(strict)
    own, all_ = Window.partitionBy("customer", "cluster"), Window.partitionBy("customer")
    best = lambda n: F.max_by("cluster", F.when(placed, F.struct(F.col(n), -F.col("cluster")))).over(all_)
    counted = gps.repartition("customer").withColumns({"n_all": F.count("*").over(own), "n_night": F.count_if(night).over(own)})
    judged = counted.withColumns({
        "n_home": F.max(F.when(placed, F.col("n_night"))).over(all_), "largest": best("n_all"), "at_night": best("n_night"),
        "nights": F.size(F.collect_set(F.when(placed & night, F.to_date("startTimestamp"))).over(all_)), "night_obs": F.count_if(placed & night).over(all_),
    })
    return judged.select(*gps.columns, _home(min_nights_obs, min_f_home, literal_f_home, strict).alias("home"))


def determine_if_at_home(df: DataFrame) -> DataFrame:
    """-1 for noise, 1 at the home cluster, else 0 (also without a home)."""
    at = F.when(F.col("cluster") == NOISE, NOISE).when(F.col("cluster") == F.col("home"), 1).otherwise(0)
    return df.withColumn("at_home", at)


def extract_home(gps: DataFrame, min_data_points: int = 50, eps_m: float = 100, min_samples: int = 10, speed_limit: float = 1.4, max_distance: float = 150, min_nights_obs: int = 4, min_f_home: float = 0.5, min_share: float | None = None, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """Quality gate, speeds, flags, clusters, home and at-home flag in turn; customers
    are clustered once.  No step holds the rows of a customer with more than
    ``in_one_task`` of them in one task."""
    for name, value in (("min_data_points", min_data_points), ("eps_m", eps_m), ("min_samples", min_samples), ("speed_limit", speed_limit), ("max_distance", max_distance)):
        if value <= 0:
            raise ValueError(f"{name} must be positive")
    if not 0 <= min_f_home <= 1:
        raise ValueError("min_f_home must lie within 0 and 1")
    moved = calculate_stationary_and_transition(calculate_distances_and_speeds(data_quality_check(gps, min_data_points)), speed_limit, max_distance)
    large = large_participants(gps, in_one_task)
    placed = _clustered(moved, eps_m, min_samples, min_data_points, min_share, large)
    if large is None:
        return compose_ids(determine_if_at_home(with_home(placed, min_nights_obs, min_f_home)))
    placed = written(placed, "placed").withColumn("who", F.struct("customer"))
    homes = find_home_cluster(placed, min_nights_obs, min_f_home).select(F.struct("customer").alias("who"), "home")
    heavy = heavy_keys(placed.groupBy("who").agg(F.count("*").alias("n")), "n")
    return compose_ids(determine_if_at_home(spread_join(placed, homes, ["who"], heavy, ["startTimestamp"], "left").drop("who")))


def identify_home(df: DataFrame, cluster: str = "clusterID") -> DataFrame:
    """Most frequent cluster per customer (ties: the smallest) as a new column."""
    return df.join(df.groupBy("customer").agg(F.mode(cluster, True).alias("home")), "customer")


def cluster_summary(places: DataFrame) -> DataFrame:
    return places.groupBy("customer").agg(
        F.count_if(F.col("cluster") == NOISE).alias("n_noise"), F.count_if(F.col("cluster") != NOISE).alias("n_clustered"),
        F.countDistinct(F.when(F.col("cluster") != NOISE, F.col("cluster"))).alias("n_clusters"),
    )


# -- mobility ----------------------------------------------------------------


def time_spent(df: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds to the next point of the group; last: 0."""
    rows = with_neighbours(df, keys, ["startTimestamp"], after=["startTimestamp"])
    spent = F.coalesce(seconds_between(F.col("startTimestamp"), F.col("after_startTimestamp")), F.lit(0.0))
    return rows.withColumn("time_spent", spent).select(*df.columns, "time_spent")


def calculate_transition_time(gps: DataFrame, keys: list[str], speed_limit: float = 1.4) -> DataFrame:
    """Percent of a group's time at walking speed or faster; 0 without time."""
    rows = with_neighbours(gps, keys, ["startTimestamp"], after=["startTimestamp", "Longitude", "Latitude"])
    metres = haversine("Longitude", "Latitude", "after_Longitude", "after_Latitude")
    gaps = rows.withColumns({"_s": seconds_between(F.col("startTimestamp"), F.col("after_startTimestamp")), "_m": metres})
    moving = F.sum(F.when((F.col("_s") > 0) & (F.col("_m") / F.nullif(F.col("_s"), F.lit(0.0)) >= speed_limit), F.col("_s")).otherwise(0.0))
    return gaps.groupBy(*keys).agg(F.coalesce(F.try_divide(moving, F.sum("_s")) * 100, F.lit(0.0)).alias("transition_time"))


def raw_location_entropy(gps: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Entropy over a grid of equal-width, right-closed bins of the group's own range.

    Differences of degrees are taken to nine digits (a tenth of a millimetre): what
    doubles add below them would move points that lie on an edge to the next bin."""
    span = gps.groupBy(*keys).agg(*[f(c).alias(f"_{n}_{c}") for c in ("Latitude", "Longitude") for n, f in (("low", F.min), ("high", F.max))])

    def bin_of(c):
        low, high = F.col(f"_low_{c}"), F.col(f"_high_{c}")
        place = F.ceil(F.try_divide(F.round((F.col(c) - low) * bins, 9), F.round(high - low, 9)))
        return F.coalesce(F.least(F.lit(bins), F.greatest(F.lit(1), place)), F.lit(1))

    cells = gps.join(span, keys).groupBy(*keys, bin_of("Latitude").alias("_a"), bin_of("Longitude").alias("_o")).agg(F.count("*").alias("n"))
    return cells.groupBy(*keys).agg(_entropy("n").alias("raw_entropy"))


def _entropy(n: str):
    """-sum p ln p of counts, from sums alone: ln N - sum(n ln n) / N."""
    total = F.sum(n)
    return F.ln(total) - F.sum(F.col(n) * F.ln(F.col(n))) / total


def calculate_metrics(gps: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Per group: entropy of the time at each exact point (or ``by``), the normalised
    one, metres, percent of time at home, clusters without and with noise.

    A group all of noise has null entropies and home share, and zeros.  Points without
    time count with a share of 1e-10; one point or none has no entropy.
    """
    by = by or ["Latitude", "Longitude"]
    rows = with_neighbours(gps, keys, ["startTimestamp"], after=["startTimestamp", "Longitude", "Latitude"])
    metres = haversine("Longitude", "Latitude", "after_Longitude", "after_Latitude")
    spent = F.coalesce(seconds_between(F.col("startTimestamp"), F.col("after_startTimestamp")), F.lit(0.0))
    rows = rows.withColumns({"time_spent": spent, "_m": F.coalesce(metres, F.lit(0.0))})
    points = rows.groupBy(*keys, *by).agg(F.sum("time_spent").alias("_t"), F.count("*").alias("_n"))
    # -sum p ln p of p = t / total, from sums alone; points without time have a share of 1e-10.
    total, timed = F.nullif(F.sum("_t"), F.lit(0.0)), F.sum(F.when(F.col("_t") > 0, F.col("_t") * F.ln("_t")).otherwise(0.0))
    entropy = F.ln(total) - timed / total - F.count_if(F.col("_t") == 0) * F.lit(1e-10 * math.log(1e-10))
    spread = points.groupBy(*keys).agg(F.when(F.sum("_n") > 1, entropy).alias("entropy"), F.count("*").alias("_k"))
    placed = F.col("cluster") != NOISE
    home_time = F.sum(F.when(F.col("cluster") == F.col("home"), F.col("time_spent")).otherwise(0.0))
    share = F.coalesce(F.try_divide(home_time, F.nullif(F.sum("time_spent"), F.lit(0.0))) * 100, F.lit(0.0))
    sums = rows.groupBy(*keys).agg(
        F.sum("_m").alias("total_distance"), F.when(F.max("home").isNotNull(), share).alias("percentage_time_at_home"),
        F.countDistinct(F.when(placed, F.col("cluster"))).alias("num_unique_clusters"), F.countDistinct("cluster").alias("num_total_clusters"),
    )
    found = sums.join(spread, keys)
    any_place = F.col("num_unique_clusters") > 0
    normal = F.col("entropy") / (F.ln(F.col("_k").cast("double")) + 1e-9)
    return found.select(
        *keys, F.when(any_place, F.col("entropy")).alias("entropy"), F.when(any_place, normal).alias("normalized_entropy"),
        F.when(any_place, F.col("total_distance")).otherwise(0.0).alias("total_distance"),
        F.when(any_place, F.col("percentage_time_at_home")).alias("percentage_time_at_home"),
        "num_unique_clusters", F.when(any_place, F.col("num_total_clusters")).otherwise(0).alias("num_total_clusters"),
    )


def daily_and_total(gps: DataFrame, key: str = "customer", day: str = "day") -> DataFrame:
    """Daily metrics with the customer's total ones, suffixed."""
    rows = gps.withColumn(day, F.to_date("startTimestamp"))
    names = lambda df, keys, suffix: df.select(*keys, *[F.col(c).alias(f"{c}{suffix}") for c in df.columns if c not in keys])
    daily = names(calculate_metrics(rows, [key, day]), [key, day], "_daily")
    return daily.join(names(calculate_metrics(rows, [key]), [key], "_total"), key)


def gps_quality_gate(gps: DataFrame, min_hours: int, min_days: int) -> DataFrame:
    """Days with enough distinct hours, then customers with enough such days."""
    rows = gps.withColumn("day", F.to_date("startTimestamp"))
    days = rows.groupBy("customer", "day").agg(F.countDistinct(F.hour("startTimestamp")).alias("n_hours")).where(F.col("n_hours") >= min_hours)
    enough = days.groupBy("customer").agg(F.count("*").alias("n_days")).where(F.col("n_days") >= min_days)
    return rows.join(days, ["customer", "day"]).join(enough, "customer")


def daily_steps(sensor: DataFrame) -> DataFrame:
    steps = sensor.where(F.col("type") == "Steps")
    return steps.groupBy("customer", F.to_date("startTimestamp").alias("day")).agg(F.sum("doubleValue").alias("n_steps"))


def steps_to_gps_day(gps_day: DataFrame, steps_day: DataFrame) -> DataFrame:
    return gps_day.join(steps_day, ["customer", "day"])
