"""Reading history as a stream (an extension: late records, windows and state are ours)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(events: DataFrame, key: str = "event_id", time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Events once each, within the watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_history(events: DataFrame, by: str = "user_id", time: str = "ts", value: str = "value", window: str = "1 hour", delay: str | None = "10 minutes") -> DataFrame:
    """Per reader and window: count, last reading and sum; late events beyond the delay are left out. delay None: events have a watermark."""
    marked = events.withWatermark(time, delay) if delay else events
    return marked.groupBy(F.window(time, window), by).agg(F.count("*").alias("n"), F.max(time).alias("last_read"), F.sum(value).alias("total")).select(F.col("window.start").alias("window_start"), by, "n", "last_read", "total")


def reading_sessions(events: DataFrame, by: str = "user_id", time: str = "ts", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions that end after a gap without events."""
    return events.withWatermark(time, delay).groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), by, "n")
