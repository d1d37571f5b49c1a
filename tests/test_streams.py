"""Streams that stop and go on against aggregates of the whole log, and a cache's events written out by hand."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from strataloom.operators import cache as C
from strataloom.streaming import cache as S
from strataloom.streaming import frontier as R
from strataloom.streaming import runs

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
LOG = "url string, seq long, state string, error string, at timestamp"
PAGES = "url string, at timestamp, seq long, fetched boolean, checksum string, etag string, last_modified string, has_output boolean"


def at(hours):
    return START + timedelta(hours=hours)


def test_frontier_goes_on_where_it_stopped(spark, tmp_path):
    draw = random.Random(3)
    rows = []
    for u in range(12):
        for seq in range(draw.randint(1, 30)):
            state = draw.choice(["queued", "processing", "succeeded", "failed", "skipped"])
            rows.append((f"u{u}", seq, state, f"e{seq}" if state == "failed" else None, at(seq + draw.random())))
    rows += [(None, 1, "queued", None, at(1)), ("u1", None, "failed", "x", at(1)), ("u2", 3, None, None, at(2))]
    rows.sort(key=lambda r: r[4])
    # late by up to a few hours, across three runs, and a third of the rows comes twice
    shuffled = sorted(rows, key=lambda r: r[4] + timedelta(hours=draw.uniform(0, 5)))
    parts = [shuffled[len(shuffled) * i // 3 : len(shuffled) * (i + 1) // 3] for i in range(3)]
    own, source = runs.stateful_session(spark), tmp_path / "log"
    folder = R.run_folder(str(tmp_path / "run"), "https://a.example", {"depth": 2})
    for part in parts:
        part = part + [r for r in part if draw.random() < 0.3]
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(source))
        log = own.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(source))
        runs.run_available(R.frontier_entries(log, "12 hours"), folder)
    want = R.batch_entries(spark.createDataFrame(rows, LOG))
    order = lambda df: sorted(map(tuple, df.select("url", "state", "attempts", "last_error", "seq").collect()))
    assert order(R.latest_entries(runs.put_out(spark, folder))) == order(want)
    # a run that finds nothing new changes nothing; other settings are another run
    runs.run_available(R.frontier_entries(own.readStream.schema(LOG).parquet(str(source)), "12 hours"), folder)
    assert order(R.latest_entries(runs.put_out(spark, folder))) == order(want)
    assert R.run_folder("b", "https://a.example", {"depth": 3}) != R.run_folder("b", "https://a.example", {"depth": 2})


def test_entries_of_a_log(spark):
    log = [("a", 1, "queued", None, at(0)), ("a", 2, "processing", None, at(1)), ("a", 3, "failed", "timeout", at(2)), ("a", 4, "processing", None, at(3)), ("a", 4, "processing", None, at(3)), ("b", 1, "failed", "x", at(0)), ("b", 2, "succeeded", None, at(1)), ("c", 7, "queued", None, at(1))]
    got = R.batch_entries(spark.createDataFrame(log, LOG))
    assert sorted(map(tuple, got.collect())) == [("a", "processing", 2, "timeout", 4), ("b", "succeeded", 0, None, 2), ("c", "queued", 0, None, 7)]
    assert sorted(r.url for r in R.unfinished(got).collect()) == ["a", "c"]


LIFE = 10  # hours
PAGE_LOG = [
    ("a", at(0), 1, False, None, None, None, True),  # nothing is known
    ("a", at(1), 2, True, "x", '"e1"\r\n', None, None),
    ("a", at(2), 3, False, None, None, None, True),  # known and there
    ("a", at(3), 4, False, None, None, None, False),  # the output is gone
    ("a", at(4), 5, True, "x", '"e2"', "Mon", None),  # the same page, and the entry lives on
    ("a", at(14), 6, False, None, None, None, True),  # just in time
    ("a", at(14.5), 7, False, None, None, None, True),  # over since 14
    ("a", at(15), 8, True, "x", "\r\n", None, None),  # stored anew; its validator is empty
    ("a", at(16), 9, False, None, None, None, True),
    ("b", at(5), 10, True, "y", None, "Tue", None),
    ("b", at(6), 11, False, None, None, None, True),
    ("c", at(40), 12, False, None, None, None, None),
    (None, at(1), 13, True, "z", "e", None, None),
    ("d", None, 14, True, "z", "e", None, None),
]
PAGE_EVENTS = [
    ("a", 0, 1, "fetch", None, None), ("a", 1, 2, "stored", None, None), ("a", 2, 3, "revalidate", '"e1"', None), ("a", 3, 4, "fetch", None, None),
    ("a", 4, 5, "unchanged", None, None), ("a", 14, 5, "evicted", None, None), ("a", 14, 6, "revalidate", '"e2"', "Mon"), ("a", 14.5, 7, "fetch", None, None),
    ("a", 15, 8, "stored", None, None), ("a", 16, 9, "fetch", None, None), ("a", 25, 8, "evicted", None, None),
    ("b", 5, 10, "stored", None, None), ("b", 6, 11, "revalidate", None, "Tue"), ("b", 15, 10, "evicted", None, None), ("c", 40, 12, "fetch", None, None),
]


def events(df):
    hours = (F.unix_micros("at") - int(START.timestamp()) * 1_000_000) / 3_600_000_000
    return sorted(map(tuple, df.select("url", hours.alias("h"), "seq", "event", "if_none_match", "if_modified_since").collect()), key=repr)


def test_cache_by_hand(spark, tmp_path):
    log = spark.createDataFrame(PAGE_LOG, PAGES)
    want = sorted(((u, float(h), *rest) for u, h, *rest in PAGE_EVENTS), key=repr)
    assert events(C.cache_events(log, LIFE * 3600)) == want
    own, source = runs.stateful_session(spark), tmp_path / "log"
    rows = [r for r in PAGE_LOG if r[0] and r[1]]
    for number, part in enumerate((rows[:4], rows[4:7] + rows[9:10], rows[7:9] + rows[10:11] + rows[11:])):
        spark.createDataFrame(part, PAGES).coalesce(1).write.mode("append").parquet(str(source))
        runs.run_available(S.cache_stream(own.readStream.schema(PAGES).parquet(str(source)), LIFE * 3600, "9 hours"), str(tmp_path / "run"), "append")
        assert number or runs.put_out(spark, str(tmp_path / "run")).count() == 4
    assert events(runs.put_out(spark, str(tmp_path / "run"))) == want


def test_live_entries(spark):
    rows = [("a", "2024-01-01T00:00:00Z"), ("b", "2024-01-09T00:00:00Z"), ("c", None), ("d", "no time"), ("e", "2024-01-03T00:00:00Z")]
    kept = C.live_entries(spark.createDataFrame(rows, "url string, fetched_at string"), F.lit("2024-01-10").cast("timestamp"), 7 * 86400)
    assert sorted(r.url for r in kept.collect()) == ["b", "c", "d", "e"]
