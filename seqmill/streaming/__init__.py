"""Streaming forms: the same windows over streams and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_event_time(events: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Event time as a timestamp with a watermark (TIMESTAMP_NTZ can't have one)."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling_counts(events: DataFrame, width: str, token: str, ts: str = "ts") -> DataFrame:
    rows = events.groupBy(F.window(ts, width), token).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), token, "n")


def sessions(events: DataFrame, key: str, gap: str, ts: str = "ts") -> DataFrame:
    """Sessions of a key: events at most ``gap`` apart."""
    rows = events.groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n"))
    return rows.select(key, F.col("session_window.start").alias("start"), "n")
