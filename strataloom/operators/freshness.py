"""How old the sources of a corpus are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400_000_000  # microseconds


def _first_times(records: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, time): the earliest record of each key that has a time."""
    known = records.where(F.col("fetched_at").isNotNull() & F.col(key).isNotNull())
    return known.groupBy(key).agg(F.min_by("fetched_at", seq).alias(f"{key}_time"))


def with_fallback_times(manifest: DataFrame, records: DataFrame, seq: str) -> DataFrame:
    """Manifest rows (document_id, url, fetched_at); those without a time take that of the first
    record of their document, else of their url, else none.

    One row a key is joined, so no manifest row is lost or multiplied; null keys find nothing.
    """
    by_document, by_url = _first_times(records, "document_id", seq), _first_times(records, "url", seq)
    joined = manifest.join(by_document, "document_id", "left").join(by_url, "url", "left")
    return joined.withColumn("fetched_at", F.coalesce("fetched_at", "document_id_time", "url_time")).drop("document_id_time", "url_time")


def age_days(fetched_at: Column, now: Column) -> Column:
    """Days from a time, or a text that holds one, to now; null for blank and unreadable ones."""
    fetched = F.try_to_timestamp(fetched_at.cast("string"))
    return F.timestamp_diff("MICROSECOND", fetched, now) / DAY


def stale(entries: DataFrame, now: Column, max_age_days: float) -> DataFrame:
    """Entries older than that, with their age in days; unordered, as sorting is the reader's choice."""
    aged = entries.withColumn("age_days", age_days(F.col("fetched_at"), now)).where(F.col("age_days") > max_age_days)
    return aged.withColumn("age_days", F.round("age_days", 2))


def staleness(entries: DataFrame, now: Column, max_age_days: float) -> DataFrame:
    """One row (entries, stale_count, unknown_age_count, oldest_days, freshest_days); no days for an empty table."""
    aged = entries.select(age_days(F.col("fetched_at"), now).alias("age"))
    return aged.agg(
        F.count("*").alias("entries"),
        F.count_if(F.col("age") > max_age_days).alias("stale_count"),
        F.count_if(F.col("age").isNull()).alias("unknown_age_count"),
        F.round(F.max("age"), 2).alias("oldest_days"),
        F.round(F.min("age"), 2).alias("freshest_days"),
    )
