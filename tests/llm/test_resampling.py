"""Importance resampling against a plain computation of every feature."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa

from strataloom.llm import resampling
from strataloom.llm.resampling import kth_key, resample, word_runs

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    lowered = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "").encode()
    words = WORD.findall(lowered)
    return words, [b" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=5, least=20):
    def counts(texts):
        out = [0] * 10000
        for text in texts:
            for f in features(text)[1]:
                out[zlib.crc32(f) % 10000] += 1
        return out

    s, t = counts(x for _, x in docs), counts(target)
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (S + 10000) / ((a + 1) * (T + 10000)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for key, text in docs:
        words, runs = features(text)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(f) % 10000] for f in runs)
        rows.append((key, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least))
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {r[0]: i + 1 for i, r in enumerate(fit[: percent * len(fit) // 100])}
    return sorted([(*r[:4], ranks.get(r[0])) for r in rows], key=repr)


def test_whole_table(spark):
    from strataloom.llm.queries import op12_importance_resampling

    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = op12_importance_resampling(spark, folder)
    assert got.columns[:5] == ["doc_id", "n_features", "weight", "score", "rank"] and set(dict(got.dtypes).values()) == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, target)


def test_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(resampling, "RANKED_ROWS", 3)
    docs = [(i, f"Ünï{i % 7} WORD-{i} x{'y' * (i * 7)} 一 " * 8) for i in range(60)] + [(100, None), (101, ""), (102, "..."), (None, "a b " * 10)]
    docs += [(103, "long " * 50 + "w" * 70 + " " + "é" * 3000)]
    target = ["a b a b", None, "word x"]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, rank int, key int")
    got = resample(frame, spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int"), percent=40)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, target, 40)
    assert resample(frame.limit(0), frame).count() == 0
    assert {r.rank for r in resample(frame, frame.limit(0), percent=0).collect()} == {None}


def test_repeated_rows_and_ties(spark):
    rows = [(1, "same words " * 20)] * 10 + [(2, "other text " * 20)] * 10
    got = resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("same",)], "text string"), percent=50).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 11)) and len({r.doc_id for r in got if r.rank}) == 1


def test_long_texts_in_parts():
    text = ("Alpha beta9 " * 40 + "x" * 900 + " ") * 5000
    whole = pa.array([text])
    assert len(text) > 4 * resampling.SLICE_BYTES
    counts = np.zeros(10000, np.int64)
    words = 0
    for own, buckets, rows in word_runs(whole):
        counts += np.bincount(buckets, minlength=10000)
        words += len(own)
        assert not own.any() and not rows.any()
    found, runs = features(text)
    want = np.bincount([zlib.crc32(f) % 10000 for f in runs], minlength=10000)
    assert words == len(found) and (counts == want).all()


def test_selection(spark):
    random = np.random.default_rng(3)
    values = [(int(v), False, int(i % 5), i) for i, v in enumerate(random.integers(-9, 9, 700))]
    keys = spark.createDataFrame([(v,) for v in values], "key struct<below:long,no_id:boolean,tie:long,row:long>").cache()
    for k in (1, 2, 350, 699, 700):
        assert kth_key(keys, k) == sorted(values)[k - 1]
