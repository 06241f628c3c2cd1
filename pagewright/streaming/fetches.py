"""Streaming variants over fetch rows (ts, site, load, failed); each takes and returns a DataFrame, streaming or not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fetch_rows(events: DataFrame) -> DataFrame:
    """The ``events`` table as fetch rows."""
    return events.select("event_id", "ts", F.col("user_id").alias("site"), F.col("value").alias("load"), (F.col("event_type") == "error").alias("failed"))


def progress_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("site").agg(F.count(F.lit(1)).alias("visited"), F.count_if("failed").alias("errors"))


def load_time_windows(rows: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    windowed = rows.withWatermark("ts", late) if rows.isStreaming else rows
    out = windowed.groupBy(F.window("ts", width).alias("w"), "site").agg(F.count(F.lit(1)).alias("n"), F.avg("load").alias("mean_load"), F.max("load").alias("max_load"))
    return out.select(F.col("w.start").alias("window_start"), "site", "n", "mean_load", "max_load")


def stream_dedup(rows: DataFrame, late: str = "2 hours") -> DataFrame:
    if rows.isStreaming:
        return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return rows.dropDuplicates(["event_id"])
