"""Structured Streaming forms of the stateful operators: windowed counts, replay protection, expiring receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts by tumbling window and key; later events than the watermark are dropped. Works on batch frames too."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "events")


def accept_once(actions: DataFrame, digest: str, at: str, within: str = "15 minutes") -> DataFrame:
    """Actions whose digest hasn't been seen within the time; state older than that is dropped."""
    return actions.withWatermark(at, within).dropDuplicatesWithinWatermark([digest])


def sessions(events: DataFrame, at: str, key: str, gap: str = "1 hour") -> DataFrame:
    """Sessions that end after an hour without an event."""
    return events.withWatermark(at, gap).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "events")
