"""Sessions and counts of event streams: the islands of peak calling, in time. An extension beyond batch analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, time: str) -> DataFrame:
    """Streams need a timestamp with a zone for their watermark; batches keep theirs."""
    return events.withColumn(time, F.col(time).cast("timestamp")) if events.isStreaming else events


def sessions(events: DataFrame, key: str = "user_id", time: str = "ts", gap: str = "30 minutes", late: str = "1 hour", least: int = 1) -> DataFrame:
    """key, start, end, n of sessions without a longer gap; late events count until the watermark passes. Batch or streaming."""
    found = timed(events, time).withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.where(F.col("n") >= least).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def window_counts(events: DataFrame, by: str = "event_type", time: str = "ts", width: str = "1 hour", step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """by, start, n of sliding windows."""
    return timed(events, time).withWatermark(time, late).groupBy(by, F.window(time, width, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), "n")
