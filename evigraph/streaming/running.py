"""Streaming forms of dedup and counts: extensions, not needed for parity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_events(events: DataFrame, key: str, time: str = "ts", late: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark; state is bounded by it."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def running_metrics(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and mean value of each type in tumbling windows."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")
