"""Frontier logs and runs against rows written out by hand."""

from pyspark.sql import functions as F

from strataloom.operators import frontier as R
from strataloom.operators import statistics as S


def test_latest_states(spark):
    log = spark.createDataFrame([("a", 1, "queued"), ("a", 3, "failed"), ("a", 2, "processing"), ("b", 1, "processing"), ("b", 4, "processing"), (None, 9, "queued"), ("c", None, "queued")], "url string, seq long, state string")
    assert sorted(map(tuple, R.latest_states(log, "url", "seq", "state").collect())) == [("a", "failed", 1), ("b", "processing", 2)]
    assert R.latest_states(log.limit(0), "url", "seq", "state").count() == 0


def test_pending(spark):
    found = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "url string")
    assert sorted(map(repr, R.pending(found, spark.createDataFrame([("a",), ("a",)], "url string"), ["url"]).collect())) == ["Row(url='b')", "Row(url='b')", "Row(url=None)"]


def test_progress(spark):
    log = spark.createDataFrame([(1, 1, "saved"), (1, 2, "queued"), (1, 3, "failed"), (2, 1, "skipped")], "run int, seq long, state string")
    assert sorted(map(tuple, R.progress(log, "run", "seq", "state").collect())) == [(1, 1, 1, 0, 0, 1), (1, 2, 1, 0, 0, 1), (1, 3, 1, 0, 1, 2), (2, 1, 0, 1, 0, 1)]


def test_regression_class(spark):
    good, bad, off = (True, True), (True, False), (False, False)
    rows = [
        (good, None, "regression"), (bad, None, "regression"), (off, None, "regression"),
        (None, good, "improvement"), (None, bad, "persistent_gap"), (None, off, "unsupported"),
        (good, off, "unsupported"), (bad, off, "unsupported"), (off, good, "improvement"), (off, bad, "improvement"),
        (good, bad, "regression"), (bad, good, "improvement"), (bad, bad, "persistent_gap"), (good, good, "unchanged"),
    ]
    run = "struct<supported:boolean,passed:boolean>"
    got = spark.createDataFrame(rows, f"b {run}, a {run}, want string").select("want", R.regression_class(F.col("b"), F.col("a")).alias("c")).collect()
    assert [r.c for r in got] == [r.want for r in got] and len(got) == len(rows)


def test_best_per_target(spark):
    runs = spark.createDataFrame([("x", 3, 5), ("x", 3, 2), ("x", 1, 1), ("y", None, 1)], "target string, score int, seq long")
    assert [tuple(r) for r in R.best_per_target(runs, "target", "score", "seq").collect()] == [("x", 3, 2)]


def test_nearest_ranks(spark):
    rows = spark.createDataFrame([("a", v) for v in (5, 1, 1, 9, None)] + [("b", None)], "g string, v int")
    got = sorted(tuple(r) for r in S.nearest_ranks(rows, ["g"], "v", {"p50": 0.5, "p95": 0.95}).collect())
    assert got == [("a", 1, 9), ("b", None, None)]
