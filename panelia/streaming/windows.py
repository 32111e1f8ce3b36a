"""Streaming forms of the windows: blocks, sliding epochs and spells of an event stream, with late data bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_counts(events: DataFrame, block: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Count and mean by block of time and key; a block is final when the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", block), "key").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select("key", F.col("window.start").alias("start"), "n", "mean")


def sliding_epochs(events: DataFrame, length: str = "60 seconds", step: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, step), "key").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).select("key", F.col("window.start").alias("start"), "n", "low", "high")


def spells(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Chains of events without a gap of ``gap`` or more."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "key").agg(F.count("*").alias("n")).select("key", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
