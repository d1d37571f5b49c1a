"""Each stage of the pipeline on its own input, and all of them in turn."""

from collections import defaultdict

import pytest

import corpus_pipeline as P
from strataloom.llm.near_dedup import near_duplicates
from tests.llm.test_near_dedup import brute
from tests.llm.test_rules_and_lines import stripped

KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def folder():
    return "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark, docs):
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, folder()).columns == docs.columns
        assert stage(spark, docs.limit(0), folder()).count() == 0


def test_quality_stage_drops_rejected_documents_only(spark):
    # the smallest tables have too few labels to learn from
    larger = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    kept = {r.doc_id for r in P.quality_stage(spark, spark.read.parquet(f"{larger}/documents.parquet"), larger).collect()}
    good = [k for k, q in labels.items() if q == 1]
    bad = [k for k, q in labels.items() if q == 0]
    assert sum(k in kept for k in good) / len(good) > 0.85 and sum(k in kept for k in bad) / len(bad) < 0.3


def test_line_stage(spark, docs):
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    got = sorted((r.doc_id, r.text) for r in P.line_stage(spark, docs, folder()).collect())
    assert got == sorted((k, t) for k, t, _, _ in stripped(rows))


def test_near_stage_keeps_one_of_each_class(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(r.doc_id for r in P.near_stage(spark, docs, folder()).collect())
    assert got == [k for k, _, _, kept in brute(rows) if kept]
    twice = docs.unionByName(docs.limit(20))
    assert sorted(r.doc_id for r in P.near_stage(spark, twice, folder()).collect()) == got
    assert near_duplicates(twice).count() == twice.count()


def test_mixing_stage_repeats_documents(spark, docs):
    counts = defaultdict(int)
    for r in P.mixing_stage(spark, docs, folder()).collect():
        counts[r.doc_id] += 1
    assert counts and max(counts.values()) <= 3


def test_stages_with_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and clashing names: what each stage keeps."""
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "some words here", "en", "a", 15), (None, "no key", "de", None, 6), (5, long, "en", "b", len(long)), (3, "some words here", "en", "a", 15)]
    rows = [(*r, 100 + i, 7, 8, "mine") for i, r in enumerate(rows)]
    odd = spark.createDataFrame(rows, f"{KIND}, _row long, _repeats int, _copy int, lines_total string")
    everything = sorted(rows, key=repr)
    got = {name: sorted(map(tuple, stage(spark, odd, folder()).collect()), key=repr) for name, stage in P.STAGES[:-1]}
    assert set(got["quality classifier"]) <= set(everything)
    lines = [(k, t or "", lang, source, len(t or ""), *rest) for k, t, lang, source, _, *rest in rows]
    assert got["line dedup"] == sorted(lines, key=repr)
    # the repeated row, whichever of the two; texts without words stay
    assert [r[:5] for r in got["minhash near-dedup"]] == sorted({r[:5] for r in rows}, key=repr) and set(got["minhash near-dedup"]) <= set(everything)
    assert {r[0] for r in got["source mixing"]} >= {3, None} and set(got["source mixing"]) <= set(everything)
    packed = P.packing_stage(spark, odd, folder()).collect()
    assert len({(r.doc_id, r.piece) for r in packed if r.doc_id == 5}) > 60 and sorted(r.length for r in packed if r.doc_id in (1, 2)) == [1, 1]


def test_quality_judges_rows_not_keys(spark):
    larger = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    kept = [r.text for r in P.quality_stage(spark, docs, larger).collect()]
    rejected = sorted({r.text for r in docs.collect()} - set(kept))
    assert rejected and len(set(kept)) > len(rejected)
    # good texts under the keys of rejected ones, and rows without a key
    bad_key = docs.where(docs["text"] == rejected[0]).first().doc_id
    more = spark.createDataFrame([(bad_key, kept[0], "en", "a", 1), (None, kept[1], "en", "a", 1), (None, rejected[1], "en", "a", 1)], KIND)
    again = [r.text for r in P.quality_stage(spark, docs.unionByName(more), larger).collect()]
    assert [again.count(t) - kept.count(t) for t in (kept[0], kept[1], rejected[1])] == [1, 1, 0]


def test_rows_without_or_with_repeated_keys(spark):
    rows = [(None, "alpha beta gamma", "en", "a", 16), (None, "one two three four", "en", "a", 18), (7, "red green blue", "en", "a", 14), (7, "north south east", "en", "a", 16), (8, "Red green blue", "en", "a", 14)]
    odd = spark.createDataFrame(rows, KIND)
    kept = P.near_stage(spark, odd, folder()).collect()
    assert sorted(r.text for r in kept) == sorted(t for _, t, *_ in rows if not t.startswith("Red"))
    # a single source takes all of itself
    mixed = P.mixing_stage(spark, odd, folder()).collect()
    assert sorted(r.text for r in mixed) == sorted(t for _, t, *_ in rows)


def test_run(spark, docs):
    got = P.run(spark, folder()).collect()
    assert got and {r.doc_id for r in got} <= {r.doc_id for r in docs.collect()}
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
