"""Structured Streaming over slice blocks and job events (extras beside the batch operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap_add(blocks: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Predictions of overlapping z blocks added up by voxel and label as blocks arrive; state ends with the watermark."""
    return blocks.withWatermark("ts", watermark).groupBy(F.window("ts", watermark), "vec_id", "z", "y", "x", "label").agg(F.sum("p").alias("p"))


def job_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type in tumbling windows, late ones dropped after the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: runs of events with no longer gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n", "total")
