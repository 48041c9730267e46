"""Sliding rates over a stream of peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_rates(rows: DataFrame, *, time_col: str = "ts", key: str = "event_type", width: str = "200 hours", step: str = "50 hours", late: str = "24 hours") -> DataFrame:
    """Rows per key and sliding window. On a stream, rows later than ``late`` are dropped and state behind the watermark is freed."""
    at = F.col(time_col).cast("timestamp")
    timed = rows.withColumn("_at", at).withWatermark("_at", late) if rows.isStreaming else rows.withColumn("_at", at)
    out = timed.groupBy(key, F.window("_at", width, step).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
