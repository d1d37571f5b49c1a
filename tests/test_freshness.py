"""Ages of sources against rows worked out by hand."""

from pyspark.sql import functions as F

from strataloom.operators import freshness as A


def test_times_fall_back_to_document_then_url(spark):
    manifest = spark.createDataFrame([("d1", "u1", "2024-01-05"), ("d2", "u2", None), ("d9", "u3", None), (None, None, None), ("d2", "u2", None)], "document_id string, url string, fetched_at string")
    records = spark.createDataFrame([(1, "d2", "u2", None), (2, "d2", "u3", "2024-01-01"), (3, "d2", "u3", "2024-01-02"), (4, None, None, "2023-01-01")], "seq int, document_id string, url string, fetched_at string")
    got = sorted(map(tuple, A.with_fallback_times(manifest, records, "seq").select("document_id", "url", "fetched_at").collect()), key=repr)
    assert got == sorted([("d1", "u1", "2024-01-05"), ("d2", "u2", "2024-01-01"), ("d2", "u2", "2024-01-01"), ("d9", "u3", "2024-01-01"), (None, None, None)], key=repr)


def test_stale_and_unknown_ages(spark):
    now = F.lit("2024-01-11 00:00:00").cast("timestamp")
    entries = spark.createDataFrame([("a", "2024-01-01 12:00:00"), ("b", "2024-01-10"), ("c", " "), ("d", "not a time"), ("e", None), ("f", "2024-01-09 00:00:00")], "url string, fetched_at string")
    assert [tuple(r) for r in A.stale(entries, now, 2.0).select("url", "age_days").collect()] == [("a", 9.5)]
    assert tuple(A.staleness(entries, now, 2.0).first()) == (6, 1, 3, 9.5, 1.0)
    assert tuple(A.staleness(entries.limit(0), now, 2.0).first()) == (0, 0, 0, None, None)
