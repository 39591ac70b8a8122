"""Queries over the driver's tables and the SQL that must agree with them.

Each query is named after its row of the operator inventory.  Times are compared as
text or whole numbers, and computed doubles to six places.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..functions import scalars as P
from ..operators import availability as av
from ..operators import ema, gps, intervals, linear, modelling, monitoring, quality, relational, reliability, scores, sensors, situations
from . import fixtures as fx
from .fixtures import with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TODAY = datetime.date(2024, 1, 31)


def _whole_counts(sql: str) -> str:
    """``count_if`` as a 64-bit number, as Spark has it."""
    out, at = [], 0
    while (i := sql.find("count_if(", at)) >= 0:
        depth, j = 1, i + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        out += [sql[at:i], "CAST(", sql[i:j], " AS BIGINT)"]
        at = j
    return "".join([*out, sql[at:]])


def query(name: str, sql: str | None = None):
    """Registers a query under the session's UTC time."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = _whole_counts(sql)
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(f"`{n}`").alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


_HAV = "2 * 6371000 * atan2(sqrt({a}), sqrt(1 - {a}))"


def _hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return _HAV.format(a=a)


from . import registry_scalars, registry_sensors, registry_streams, registry_sources, registry_study  # noqa: E402,F401  they register their queries
