"""Queries on change events between two snapshots, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import changes as H
from strataloom.plans.documents import both
from strataloom.plans.tables import SQL_SNAPSHOTS


def _snapshots(spark, sf_dir):
    return [rows.withColumn("document_id", F.col("content_hash")) for rows in both(spark, sf_dir)]


def change_events(spark, sf_dir):
    """Urls that differ between the snapshots, with what differs and a key that reruns repeat."""
    events = H.changed_urls(*_snapshots(spark, sf_dir), "content_hash")
    return events.select("url", F.coalesce("old_n", F.lit(0)).alias("old_n"), F.coalesce("new_n", F.lit(0)).alias("new_n"), F.array_join("structural", ",").alias("structural"), "idempotency_key")


def change_line_edits(spark, sf_dir):
    """The line edits of each url that differs."""
    events = H.change_events(*_snapshots(spark, sf_dir), "content_hash")
    return events.select("url", F.posexplode("textual").alias("edit", "e")).select("url", "edit", "e.*")


QUERIES = [change_events, change_line_edits]

_SIDE = "SELECT url, count(*) AS n, list_sort(coalesce(list(DISTINCT content_hash), [])) AS h, list_sort(list(DISTINCT title)) AS t FROM"

SQL = {
    "change_events": f"""{SQL_SNAPSHOTS}, a AS ({_SIDE} old GROUP BY url), b AS ({_SIDE} new GROUP BY url),
      j AS (SELECT coalesce(a.url, b.url) AS url, a.n AS an, b.n AS bn, a.h AS ah, b.h AS bh, a.t AS old_t, b.t AS new_t FROM a FULL OUTER JOIN b ON a.url = b.url)
      SELECT url, coalesce(an, 0) AS old_n, coalesce(bn, 0) AS new_n, concat_ws(',', CASE WHEN an IS NULL THEN 'document_added' WHEN bn IS NULL THEN 'document_removed' END,
        CASE WHEN coalesce(an, 0) <> coalesce(bn, 0) THEN 'record_count_changed' END, CASE WHEN coalesce(old_t, []) <> coalesce(new_t, []) THEN 'title_changed' END) AS structural,
        sha256(url || chr(10) || coalesce(array_to_string(ah, ','), '') || chr(10) || coalesce(array_to_string(bh, ','), '')) AS idempotency_key
      FROM j WHERE ah IS DISTINCT FROM bh OR old_t IS DISTINCT FROM new_t""",
}
