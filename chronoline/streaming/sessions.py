"""Structured Streaming over an event table: windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events as a stream of files; the schema is that of the files already there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def departures_by_hour(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(window, event_type, n): tumbling hours; events later than ``late`` are dropped with their window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))


def user_sessions(events: DataFrame, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """(session, user_id, n): sessions that end after ``gap`` without an event."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("session"), "user_id").agg(F.count("*").alias("n"))


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all that is there now, and read what it appended: windows that the watermark has closed."""
    run = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
