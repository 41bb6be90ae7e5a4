"""Windowed counts of an event stream, as an extension: the batch operators have no stream of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """window start, event_type, n and total of events (ts, event_type, value); rows later than `late` are left out."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return counted.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
