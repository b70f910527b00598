"""Review activity over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicate(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Drop re-deliveries of an event that arrive within the watermark."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def hourly_activity(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events and distinct users per window and type, counted alike in batch and stream.

    Events are first counted per window, type and user, and those rows then per window and type.  A stream so keeps one
    small state row for each user of a window, spread over all tasks, until the watermark closes the window; no row
    holds a set of users, and a busy window has no task of its own.
    """
    per_user = events.groupBy(F.window("ts", width).alias("w"), "event_type", "user_id").agg(F.count("*").alias("n"))
    counted = per_user.groupBy("w", "event_type").agg(
        F.sum("n").alias("n"), F.count("user_id").alias("users"))
    return counted.select("event_type", F.col("w.start").alias("window_start"), "n", "users")


def start_activity(events: DataFrame, sink: str, checkpoint: str, lateness: str = "10 minutes"):
    """Append closed windows to Parquet, processing everything available."""
    counts = hourly_activity(deduplicate(events, lateness))
    return (
        counts.writeStream.outputMode("append").format("parquet").option("path", sink)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
