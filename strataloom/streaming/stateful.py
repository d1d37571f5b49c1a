"""Streaming forms of the stateful operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(stream: DataFrame, key: str, time: str, watermark: str = "1 day") -> DataFrame:
    """The first row of each key; a key is forgotten when the watermark has passed it."""
    return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, by: str, length: str, watermark: str) -> DataFrame:
    """(start, end, by, n) for each window; rows later than the watermark are left out."""
    window = F.window(time, length)
    counts = stream.withWatermark(time, watermark).groupBy(window, by).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n")


def sessions(stream: DataFrame, time: str, by: str, gap: str, watermark: str) -> DataFrame:
    """(start, end, by, n) for each run of rows with no pause of ``gap``."""
    window = F.session_window(time, gap)
    counts = stream.withWatermark(time, watermark).groupBy(window, by).agg(F.count("*").alias("n"))
    return counts.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")
