"""Batches, windows and mentions against plain loops; the project's records against the ordered fold."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.operators import batches as B
from strataloom.operators import mentions as M
from strataloom.plans import project as P
from tests.test_merging import folded


def looped(rows, most_tokens, most_rows):
    """{n: batch} of (n, tokens) taken in order."""
    out, batch, tokens, held = {}, 0, 0, 0
    for n, t in sorted(rows):
        if held and (tokens + t > most_tokens or held >= most_rows):
            batch, tokens, held = batch + 1, 0, 0
        out[n] = batch
        tokens += t
        held += 1
    return out


@pytest.mark.parametrize(("block", "most_rows"), [(1 << 16, 100), (64, 7), (10, 10)])
def test_batches_in_blocks(spark, block, most_rows):
    draw = random.Random(block)
    rows = [(g, i * 3 + k, draw.choice([0, 1, 5, 40, 400])) for k, g in enumerate(["a", None, "b"]) for i in range((700, 65, 1)[k])]
    frame = spark.createDataFrame(rows, "g string, n long, t long").repartition(6)
    got = {r.n: (r.g, r.batch) for r in B.greedy_batches(frame, "g", ["n"], F.col("t"), 300, most_rows, block).collect()}
    want = {n: (g, b) for g in ("a", None, "b") for n, b in looped([(n, t) for h, n, t in rows if h == g], 300, most_rows).items()}
    assert got == want
    assert B.greedy_batches(frame.limit(0), "g", ["n"], F.col("t")).count() == 0


def test_starts_with_negative_tokens():
    draw = np.random.default_rng(1)
    tokens = draw.integers(-3, 9, 300)
    total = np.cumsum(tokens)
    got = B._next_starts(total, tokens, 20, 12)
    for i in range(300):
        end = i + 1
        while end < i + 12 and not (end < 300 and total[end] - total[i] + tokens[i] > 20):
            end += 1
        assert got[i] == end


def test_long_group_of_many_blocks(spark):
    """10^6 rows, both limits at work, and a batch boundary that depends on all before it."""
    rows = spark.range(1_000_000).select(F.lit("x").alias("g"), F.col("id").alias("n"), F.pmod(F.xxhash64("id"), F.lit(150)).alias("t"))
    got = B.greedy_batches(rows, "g", ["n"], F.col("t"), 7000, 100).orderBy("n").toPandas()
    want = looped(zip(got["n"].tolist(), got["t"].tolist(), strict=True), 7000, 100)
    assert len(got) == 1_000_000 and got["batch"].tolist() == [want[n] for n in got["n"].tolist()]


def windows(text, most, overlap):
    size = lambda line: -(-len(line.encode("utf-16-le")) // 8)
    out, now, tokens = [], [], 0
    for line in text.split("\n"):
        if tokens + size(line) > most and now:
            out.append("\n".join(now))
            tail, held = [], 0
            for old in reversed(now):
                if held + size(old) > overlap:
                    break
                tail.insert(0, old)
                held += size(old)
            now, tokens = tail, held
        now.append(line)
        tokens += size(line)
    return [*out, "\n".join(now)]


def test_windows():
    draw = random.Random(4)
    for _ in range(300):
        text = "\n".join("x🙂"[: draw.randint(0, 2)] * draw.randint(0, 40) for _ in range(draw.randint(0, 60)))
        most, overlap = draw.randint(1, 60), draw.randint(0, 20)
        got = B.line_windows(text, most, overlap)
        assert [c for _, _, _, c in got] == windows(text, most, overlap) and [n for n, *_ in got] == list(range(len(got)))
    assert B.line_windows("") == [(0, None, 0, "")]
    assert B.line_windows("a\n## Title here\n# Next")[0][1] == "Title here"


def test_windows_of_a_table(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {(r.doc_id, r.chunk_index): r.sha256 for r in P.overlap_windows(spark, sf_dir).collect()}
    assert got == {(k, i): hashlib.sha256(w.encode()).hexdigest() for k, t in texts.items() for i, w in enumerate(windows(t, 1000, 200))}


NAMES = ["API", "Straße", "ab", "x", "Ünïcode name", "the longer name of a thing", "no such name", "", None, "api", "a b c d e", "🙂🙂"]


@pytest.mark.parametrize("most", [1 << 20, 10])
def test_name_matches(spark, monkeypatch, most):
    monkeypatch.setattr(M, "AUTOMATON_BYTES", most)  # beyond it names are dealt by grams
    draw = random.Random(7)
    words = ["api", "STRASSE", "strasse", "ab", "cd", "ünïcode", "Name", "the LONGER name of a thing", "a b c", "d e", "🙂", "xyz", "\n"]
    texts = [(i, " ".join(draw.choices(words, k=draw.randint(0, 12)))) for i in range(200)] + [(200, None), (201, ""), (202, "a" * 100_000 + "Straße")]
    found = M.name_matches(spark.createDataFrame(texts, "doc_id long, content string"), spark.createDataFrame([(n,) for n in NAMES], "name string"))
    want = {(k, n.casefold(), (t or "").casefold().find(n.casefold())) for k, t in texts for n in NAMES if n and n.casefold() in (t or "").casefold()}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    none = spark.createDataFrame([], "name string")
    assert M.name_matches(spark.createDataFrame(texts, "doc_id long, content string"), none).count() == 0


def test_chunk_mentions_of_a_table(spark, sf_dir):
    texts = {r.doc_id: (r.text or "").casefold() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    entities = {r.entity_id: sorted({c.strip().casefold() for c in r.candidates} - {""}) for r in P._entities(spark, sf_dir).collect()}
    want = {(k, e, *next((c, t.find(c)) for c in cs if c in t)) for k, t in texts.items() for e, cs in entities.items() if any(c in t for c in cs)}
    got = P.chunk_mentions(spark, sf_dir).collect()
    assert len(got) == len(want) > 0 and {(r.doc_id, r.entity_id, r.name, r["at"]) for r in got} == want


def test_project_dedup_of_a_table(spark, sf_dir):
    rows = P.project_records(spark, sf_dir).select("doc_id", P.project_keys().alias("k"), P.project_quality().alias("q"), "title", "url", "content").collect()
    assert all(r.k[1] == "url:https://" + re.sub("/$", "", r.url[8:-5]).lower().removesuffix("/") for r in rows if r.title)
    got = sorted(map(tuple, P.project_dedup(spark, sf_dir).collect()))
    assert got == folded([(r.doc_id, r.k, r.q) for r in rows]) and len(got) < len(rows)
