"""A cache of fetched pages as a log: what requests find, what fetches change, what expires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def validator(value: Column) -> Column:
    """A stored validator fit for a header: no line breaks or zero bytes, null if nothing is left."""
    bare = F.btrim(F.translate(value, "\r\n\u0000", ""))
    return F.when(bare != "", bare)


def cache_events(log: DataFrame, ttl_seconds: int, until: Column | None = None) -> DataFrame:
    """(url, at, seq, event, if_none_match, if_modified_since) from a log (url, at, seq, fetched, checksum, etag, last_modified, has_output).

    A fetch (``fetched``) stores an entry, which replaces an older one; its event is ``unchanged`` if the
    entry that it replaces was there and had its checksum, else ``stored``.  A request finds the last
    entry stored up to then, unless that is older than the time to live: with a validator, and
    if the page's output is still there, it is to ``revalidate`` with the validators, else to ``fetch``.
    An entry that no fetch replaces in time is ``evicted`` when its time ends, if that is before
    ``until``, by default the log's last time; the event's seq is that of the fetch.  Rows without an address, a time or a
    seq are none.  The rows of one address are gone through in one task.
    """
    rows = log.where("url is not null and at is not null and seq is not null")
    life = F.expr(f"INTERVAL {ttl_seconds} SECONDS")
    entry = F.when(F.col("fetched"), F.struct("at", "checksum", validator(F.col("etag")).alias("etag"), validator(F.col("last_modified")).alias("last_modified")))
    order = Window.partitionBy("url").orderBy("at", "seq")
    held = rows.withColumn("entry", F.last(entry, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    held = held.withColumn("next", F.first(F.when(F.col("fetched"), F.col("at")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    alive = F.col("entry").isNotNull() & (F.col("entry.at") + life >= F.col("at"))
    known = F.col("entry.etag").isNotNull() | F.col("entry.last_modified").isNotNull()
    revalidate = alive & known & F.coalesce(F.col("has_output"), F.lit(False))
    same = alive & F.col("entry.checksum").eqNullSafe(F.col("checksum"))
    event = F.when(F.col("fetched"), F.when(same, "unchanged").otherwise("stored")).when(revalidate, "revalidate").otherwise("fetch")
    header = lambda name: F.when(F.col("event") == "revalidate", F.col(f"entry.{name}"))
    found = held.withColumn("event", event).select("url", "at", "seq", "event", header("etag").alias("if_none_match"), header("last_modified").alias("if_modified_since"))
    end = F.col("at") + life
    last = rows.agg((F.max("at") if until is None else F.first(until)).alias("until"))
    over = held.where("fetched").join(F.broadcast(last)).where((F.col("next").isNull() | (F.col("next") > end)) & (end < F.col("until")))  # one row
    none = F.lit(None).cast("string")
    return found.unionByName(over.select("url", end.alias("at"), "seq", F.lit("evicted").alias("event"), none.alias("if_none_match"), none.alias("if_modified_since")))


def live_entries(manifest: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Entries of a manifest that stay: those whose ``fetched_at`` is missing or unreadable, or not older than the time to live."""
    fetched = F.try_to_timestamp(F.col("fetched_at").cast("string"))
    return manifest.where(fetched.isNull() | (fetched >= now - F.expr(f"INTERVAL {ttl_seconds} SECONDS")))
