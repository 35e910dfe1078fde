"""Bars from an event stream: watermark, tumbling windows, late events within the watermark counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(events: DataFrame, minutes: int = 5, late: str = "1 hour") -> DataFrame:
    """``events``: ts, event_type, value, as a stream or a table. asset, ts, px (mean), n of each closed window."""
    w = F.window("ts", f"{minutes} minutes")
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.col("event_type").alias("asset"), w.alias("w")).agg(F.avg("value").alias("px"), F.count("*").alias("n")).select("asset", F.col("w.start").alias("ts"), "px", "n")
