"""Metrics of runs: tall tables of run_id, test_id, scope, key, metric and value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compared(metrics: DataFrame, base: str, other: str) -> DataFrame:
    """By key and metric of two runs: both values, their difference, and the ratio where base isn't 0."""
    keys = ["test_id", "scope", "key", "metric"]
    a = metrics.filter(F.col("run_id") == base).select(*keys, F.col("value").alias("base"))
    b = metrics.filter(F.col("run_id") == other).select(*keys, F.col("value").alias("other"))
    return a.join(b, keys).withColumn("difference", F.col("other") - F.col("base")).withColumn("ratio", F.try_divide("other", "base"))


def macro_average(metrics: DataFrame) -> DataFrame:
    """Each metric's mean over tests, by scope and key, with the number of tests."""
    return metrics.groupBy("run_id", "scope", "key", "metric").agg(F.avg("value").alias("mean"), F.count("value").alias("tests"))


def success_rate(metrics: DataFrame, least: float = 0.7) -> DataFrame:
    """The share of tests whose f1 is over least, by run and key."""
    f1 = metrics.filter("metric = 'f1'")
    return f1.groupBy("run_id", "key").agg(F.avg((F.col("value") > least).cast("int")).alias("success"), F.count("*").alias("tests"))
