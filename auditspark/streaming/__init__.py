"""Streaming forms of two operators; an addition to the batch ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequent_small_amounts(events: DataFrame, at: str = "ts", key: str = "user_id", value: str = "value", largest: float = 100.0, days: int = 30, least: int = 10, late: str = "1 day") -> DataFrame:
    """Sliding windows of `days` in which a key has `least` small amounts or more. State is one counter a key
    and window, dropped when the watermark passes it."""
    small = events.filter(F.col(value) <= largest).withWatermark(at, late)
    counted = small.groupBy(F.window(at, f"{days} days", "1 day"), key).agg(F.count("*").alias("n_rows"), F.sum(value).alias("total"))
    return counted.filter(F.col("n_rows") >= least).select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n_rows", "total")


def sessions(events: DataFrame, at: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a key's events with pauses of at most `gap`."""
    counted = events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n_events"))
    return counted.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_events")
