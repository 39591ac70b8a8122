"""Interruption alerts as a stream that starts from the roster.

Each participant under observation has a state from the first batch on, whether or
not any data came: the last GPS point, the last passive record and the category they
are in.  Data and timers move a participant from one category to another; each move
is told, the end of an alert included.  The clock is the watermark.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.monitoring import ACTIVE

CHANGES = "customer string, for_id string, category string, since timestamp, number long"
STATE = "for_id string, gps long, passive long, category string, number long"
DAY_MS = 86_400_000
#: The kinds of data that are watched.
GPS, PASSIVE = ("Latitude", "Longitude"), ("HeartRate",)
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def category(gps: int | None, passive: int | None, ago: int, watched: bool = True, located: bool = True) -> str | None:
    """As ``monitoring.interruptions`` has it, for times in milliseconds; null is no time."""
    if gps is None:
        return "no_gps_at_all" if located else None
    if passive is None or gps == ago or passive == ago:
        return None
    if gps > ago and passive < ago:
        return "no_pd" if watched else None
    if gps < ago and passive > ago:
        return "no_gps" if located else None
    return "no_gpspd" if gps < ago else None


class Watch(StatefulProcessor):
    """State: last times (-1: none), category and the number of changes told.  As most
    participants send a few rows or none, rows come one by one and not as frames."""

    def __init__(self, days: int, no_watch: tuple[str, ...], no_gps: tuple[str, ...]) -> None:
        self.days, self.no_watch, self.no_gps = days, set(no_watch), set(no_gps)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", STATE)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.seen.update((initialState.for_id, -1, -1, "", 0))
        self.handle.registerTimer(1)  # due as soon as there is a watermark

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        gps, passive = -1, -1
        for row in rows:
            if row.located:
                gps = max(gps, row.at)
            else:
                passive = max(passive, row.at)
        held = self.seen.get()
        if held is None:  # nobody who is observed
            return
        for_id, old_gps, old_passive, was, number = held
        for newer, older in ((gps, old_gps), (passive, old_passive)):
            if newer > older and (older < 0 or newer // DAY_MS > older // DAY_MS):  # the midnight from which on it is too long ago
                self.handle.registerTimer((newer // DAY_MS + self.days + 1) * DAY_MS)
                self.handle.registerTimer((newer // DAY_MS + self.days) * DAY_MS)
        yield from self.judged(key, timerValues, held, (for_id, max(gps, old_gps), max(passive, old_passive), was, number))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.seen.get()
        if held is not None:
            yield from self.judged(key, timerValues, held, held)

    def judged(self, key, timerValues, held: tuple, state: tuple) -> Iterator[Row]:
        """Keeps ``state`` (``held`` before) and tells of a change of category."""
        now, (for_id, gps, passive, was, number) = timerValues.getCurrentWatermarkInMs(), state
        today = now // DAY_MS * DAY_MS
        found = was
        if now > 0:
            found = category(None if gps < 0 else gps, None if passive < 0 else passive, today - self.days * DAY_MS, for_id not in self.no_watch, for_id not in self.no_gps) or ""
        told = found != was
        state = (for_id, gps, passive, found, number + told)
        if state != tuple(held):
            self.seen.update(state)
        if told:
            since = datetime.datetime.fromtimestamp(today / 1000, datetime.timezone.utc)
            yield Row(customer=key[0], for_id=for_id, category=found or None, since=since, number=number + 1)

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession):
    """State in RocksDB, which processors with timers need, for queries started within."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def stream_interruptions(sensor: DataFrame, roster: DataFrame, days: int = 7, lateness: str = "1 day", statuses=ACTIVE, no_watch: tuple[str, ...] = (), no_gps: tuple[str, ...] = (), gps: tuple[str, ...] = GPS, passive: tuple[str, ...] = PASSIVE) -> DataFrame:
    """Changes of category: customer, for_id, category (null: the alert ended), since
    (the day by the watermark), number (counts a participant's changes); update mode.

    After each batch, the last change of every participant is what
    ``monitoring.interruptions`` says of the data so far, ``days`` before the
    watermark's day.  ``roster`` (customer, for_id, status) is the initial state; data
    of others is passed over.  Start the query within ``rocks(spark)``.
    """
    rows = sensor.where(F.col("type").isin(*gps, *passive)).withWatermark("startTimestamp", lateness)
    rows = rows.select("customer", "startTimestamp", F.unix_millis("startTimestamp").alias("at"), F.col("type").isin(*gps).alias("located"))
    people = roster.where(F.col("status").isin(*statuses)).dropDuplicates(["customer"]).select("customer", "for_id")
    return rows.groupBy("customer").transformWithState(Watch(days, no_watch, no_gps), CHANGES, "Update", "EventTime", people.groupBy("customer"))


def current_alerts(changes: DataFrame) -> DataFrame:
    """customer, for_id, category, since: the alerts that stand after all ``changes``."""
    last = changes.groupBy("customer").agg(F.max_by(F.struct("for_id", "category", "since"), "number").alias("last"))
    return last.select("customer", "last.*").where("category IS NOT NULL")
