"""Structured Streaming over event tables: tumbling windows, sessions, incremental labels. An extension; batch queries need none of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, schema: str = EVENTS, files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, ``files`` of them a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and their total value by window and type; rows later than ``late`` behind the newest are left out."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return out.agg(F.count("*").alias("events"), F.sum("value").alias("total")).select("window.start", "window.end", "event_type", "events", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user: events less than ``gap`` apart."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))
    return out.select("session_window.start", "session_window.end", "user_id", "events")


def into_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write a stream to Parquet until its input is used up; a restart goes on where the checkpoint stands."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
