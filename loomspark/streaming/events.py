"""Structured Streaming extensions over event-like streams.

The reference has no streaming; these wrap the batch operators for tables that keep growing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def slot_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and summed value by time window and type; rows later than ``late`` are left out of closed windows."""
    rows = events.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("inicio"), "event_type", "n", "total")


def write_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there, append closed windows, and stop."""
    df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
