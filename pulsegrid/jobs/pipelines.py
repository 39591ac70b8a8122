"""The three workloads: ingest, block features, models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import availability, ema, gps, intervals, linear, modelling, relational, sensors
from ..sources.readers import clean_epochs


def ingest(epochs: DataFrame, roster: DataFrame, store: DataFrame | None = None, unit: str = "ms") -> DataFrame:
    """Raw records to clean, local-time ones with the roster; only rows later than the
    store's.  One projection, one scalar, one broadcast join."""
    rows = clean_epochs(epochs, unit)
    if store is not None:
        mark = store.agg(F.max("startTimestamp")).first()[0]
        rows = rows if mark is None else rows.where(F.col("startTimestamp") > F.lit(mark))
    return relational.attach_roster(rows, roster)


def adherence(sensor: DataFrame, bounds: DataFrame) -> DataFrame:
    """Daily availability per customer and type over the whole phase."""
    daily = availability.daily_availability(availability.hourly_presence(sensor))
    return availability.with_relative_day(availability.densify_days(daily, bounds), bounds)


def block_features(sensor: DataFrame, blocks: DataFrame, places: DataFrame) -> DataFrame:
    """Heart rate, steps, activity and GPS features of every block, in one wide row:
    one overlap join for all sensor records, one for the GPS points."""
    near = intervals.prefilter_time_range(sensor, blocks)
    found = blocks.join(sensors.map_readings_to_ema(blocks, near), sensors.BLOCK)
    return found.join(sensors.map_gps_and_transition_to_ema(blocks, places), sensors.BLOCK)


def features(sensor: DataFrame, ema_long: DataFrame, items: list[str], hours: float = 2, min_daily: int = 4, min_days: int = 7, **home) -> DataFrame:
    """Workload B: gated prompts, blocks, places, and their features with mean affect."""
    gated = ema.compliance_gate(ema_long, min_daily, min_days)
    wide = relational.numeric_items(ema.pivot_items(gated, ema.PROMPT, items), items)
    affect = ema.negative_affect(wide, items).select(*ema.PROMPT, "mean_na")
    blocks = ema.ema_blocks(gated, hours)
    own = relational.keep_customers(sensor, blocks)
    places = gps.extract_home(gps.pivot_gps(own).dropna(), **home)
    return block_features(own, blocks, places).join(affect, ema.PROMPT)


def evaluate(table: DataFrame, y: str, numbers: list[str], n_folds: int = 5, ratio: float = 0.1, model: str = "linear") -> dict:
    """Workload C: user holdout, time split, folds, grid, inner and holdout metrics."""
    rest, holdout = modelling.outer_user_split(table, ratio)
    split = modelling.inner_time_split(rest)
    train, test = split.where("is_train"), split.where("not is_train")
    train, test, holdout = modelling.preprocess(train, [test, holdout], numbers, [], [], {})
    train = modelling.forward_chaining_folds(train, n_folds).cache()
    if model == "linear":
        fitted, best, scores = linear.linear_grid_search(train, n_folds, modelling.LINEAR_GRID, y)
    else:
        fitted, best, scores = modelling.grid_search(train, n_folds, modelling.fit_forest, modelling.FOREST_GRID, y)
    said = {
        "best": best,
        "scores": scores,
        "inner": modelling.regression_metrics(fitted.transform(test), y).first().asDict(),
        "holdout": modelling.holdout_baseline(fitted.transform(holdout), y).first().asDict(),
    }
    train.unpersist()
    return said
