"""Streams over the events table, run to its end, and the same results as aggregates, with SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strataloom.lineage import shared_folder
from strataloom.operators import cache as C
from strataloom.plans.tables import table
from strataloom.streaming import cache as S
from strataloom.streaming import frontier as R
from strataloom.streaming import runs

TTL = 3 * 86400


def _transitions(events):
    """Events as transitions: users are addresses, errors fail with their properties as message."""
    kinds = F.create_map(*[F.lit(x) for pair in (("click", "processing"), ("view", "queued"), ("purchase", "succeeded"), ("signup", "skipped")) for x in pair])
    state = F.coalesce(kinds[F.col("event_type")], F.lit("failed"))
    return events.select(F.concat(F.lit("user:"), "user_id").alias("url"), F.col("event_id").alias("seq"), state.alias("state"), F.when(state == "failed", F.col("props")).alias("error"), F.col("ts").cast("timestamp").alias("at"))


def frontier_entries(spark, sf_dir):
    return R.batch_entries(_transitions(table(spark, sf_dir, "events")))


def frontier_unfinished(spark, sf_dir):
    return R.unfinished(frontier_entries(spark, sf_dir)).select("url", "state", "attempts")


def frontier_stream(spark, sf_dir):
    """The same entries, kept by a stream that goes over the table's files."""
    own = runs.stateful_session(spark)
    folder = R.run_folder(f"{shared_folder(spark)}/frontier-{uuid.uuid4().hex}", sf_dir, {"table": "events"})
    runs.run_available(R.frontier_entries(_transitions(runs.table_stream(own, f"{sf_dir}/events.parquet"))), folder)
    return R.latest_entries(runs.put_out(spark, folder))


def _cache_log(events):
    """Events as a cache's log: purchases and errors fetch, the others ask; a value stands for the page, errors send no validators."""
    fetched = F.col("event_type").isin("purchase", "error")
    sent = F.col("event_type") == "purchase"
    page = F.floor(F.col("value") / 40).cast("string")
    return events.select(
        F.concat(F.lit("user:"), "user_id").alias("url"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), fetched.alias("fetched"), page.alias("checksum"),
        F.when(sent, F.concat(F.lit('"'), page, F.lit('"\r\n'))).alias("etag"), F.when(sent & (F.col("value") > 80), F.date_format("ts", "yyyy-MM-dd")).alias("last_modified"), (F.col("event_type") != "signup").alias("has_output"),
    )


def cache_events(spark, sf_dir):
    return C.cache_events(_cache_log(table(spark, sf_dir, "events")), TTL)


def cache_stream(spark, sf_dir):
    """The same events from a stream, whose timers evict entries up to the watermark."""
    own = runs.stateful_session(spark)
    folder = f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}"
    runs.run_available(S.cache_stream(_cache_log(runs.table_stream(own, f"{sf_dir}/events.parquet")), TTL, "0 seconds"), folder, "append")
    return runs.put_out(spark, folder).drop("batch")


QUERIES = [frontier_entries, frontier_unfinished, frontier_stream, cache_events, cache_stream]

_ENTRIES = """WITH t AS (SELECT 'user:' || user_id AS url, event_id AS seq, CASE event_type WHEN 'click' THEN 'processing' WHEN 'view' THEN 'queued' WHEN 'purchase' THEN 'succeeded' WHEN 'signup' THEN 'skipped' ELSE 'failed' END AS state, props FROM events),
  e AS (SELECT url, arg_max(state, seq) AS state, count(*) FILTER (state = 'processing') AS attempts,
    CASE WHEN arg_max(state, seq) FILTER (state IN ('succeeded', 'skipped', 'failed')) = 'failed' THEN arg_max(props, seq) FILTER (state IN ('succeeded', 'skipped', 'failed')) END AS last_error, max(seq) AS seq FROM t GROUP BY 1)"""

_CACHE = f"""WITH l AS (SELECT 'user:' || user_id AS url, ts, event_id AS seq, event_type IN ('purchase', 'error') AS fetched, floor(value / 40)::BIGINT::VARCHAR AS page, event_type, value FROM events),
  v AS (SELECT *, CASE WHEN event_type = 'purchase' THEN '"' || page || '"' END AS etag, CASE WHEN event_type = 'purchase' AND value > 80 THEN strftime(ts, '%Y-%m-%d') END AS modified FROM l),
  h AS (SELECT *, last_value(CASE WHEN fetched THEN {{'ts': ts, 'page': page, 'etag': etag, 'modified': modified}} END IGNORE NULLS) OVER (PARTITION BY url ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e,
    first_value(CASE WHEN fetched THEN ts END IGNORE NULLS) OVER (PARTITION BY url ORDER BY ts, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM v),
  s AS (SELECT *, coalesce(e.ts + INTERVAL {TTL} SECOND >= ts, false) AS alive FROM h),
  f AS (SELECT *, CASE WHEN fetched THEN CASE WHEN alive AND e.page = page THEN 'unchanged' ELSE 'stored' END WHEN alive AND (e.etag IS NOT NULL OR e.modified IS NOT NULL) AND event_type <> 'signup' THEN 'revalidate' ELSE 'fetch' END AS event FROM s)
  SELECT url, ts AS "at", seq, event, CASE WHEN event = 'revalidate' THEN e.etag END AS if_none_match, CASE WHEN event = 'revalidate' THEN e.modified END AS if_modified_since FROM f
  UNION ALL SELECT url, ts + INTERVAL {TTL} SECOND, seq, 'evicted', NULL, NULL FROM h WHERE fetched AND (nxt IS NULL OR nxt > ts + INTERVAL {TTL} SECOND) AND ts + INTERVAL {TTL} SECOND < (SELECT max(ts) FROM l)"""

SQL = {
    "frontier_entries": f"{_ENTRIES} SELECT * FROM e",
    "frontier_unfinished": f"{_ENTRIES} SELECT url, state, attempts FROM e WHERE state NOT IN ('succeeded', 'skipped')",
    "frontier_stream": f"{_ENTRIES} SELECT * FROM e",
    "cache_events": _CACHE,
    "cache_stream": _CACHE,
}
