"""Detection and metrics over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sablespan.operators.extract import Pattern, find_spans


def document_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Documents as Parquet files arrive in a folder."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def span_stream(documents: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """The same spans as over a table: detection keeps no state."""
    return find_spans(documents, patterns)


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and type, for streams and tables: count and sum in cents."""
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    grouped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return grouped.agg(F.count("*").alias("n"), cents.alias("cents")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "cents")


def to_table(rows: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run once over what is there, into an in-memory table of that name."""
    writer = rows.writeStream.format("memory").queryName(name).outputMode(mode)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
