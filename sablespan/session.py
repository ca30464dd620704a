"""Session settings that the engine's plans are made for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "sablespan", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; conf adds to it or overrides."""
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.appName(name)
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
