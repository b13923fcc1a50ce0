"""Incremental compositing of an event stream: an extension beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_composite(events: DataFrame, time: str, keys: list[str], value: str, width: str = "15 days", late: str = "15 days") -> DataFrame:
    """Approximate median and count of value by window and keys; rows later than `late` are dropped by the watermark."""
    w = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), *keys)
    return w.agg(F.percentile_approx(value, 0.5).alias("v"), F.count(value).alias("n")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "v", "n")
