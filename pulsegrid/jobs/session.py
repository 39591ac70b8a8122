"""Session settings that the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "pulsegrid", **settings: str) -> SparkSession:
    """A session with adaptive plans and UTC times; the cluster's settings stay."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
