"""Edited counts against encoding the edited text anew."""

import random

import public_tokenizers
import pytest

from strataloom.llm.token_counts import LEAF, PreTokens, TokenTree, edit_trees, edited_counts, gather_edits, token_trees

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ALPHABET = ["a", "Bc", "the ", " word", "'s", "'", "ll", " ", "  ", "\n", "\n\n", "\t", "12", "3", ".", "!?", "é", "日本", "😀", " 's", "\r\n"]


@pytest.fixture(scope="module")
def pre():
    return PreTokens(PATH, PATTERN)


@pytest.mark.parametrize("seed", range(6))
def test_random_edits(pre, seed):
    rng = random.Random(seed)
    text = "".join(rng.choices(ALPHABET, k=rng.choice([0, 3, 60, 900])))
    tree = TokenTree(text, pre)
    for _ in range(120):
        start, deleted = rng.randint(0, len(text) + 2), rng.choice([0, 0, 1, 2, 5, 80])
        inserted = "".join(rng.choices(ALPHABET, k=rng.choice([0, 1, 2, 6])))
        tree.edit(start, deleted, inserted)
        at = min(start, len(text))
        text = text[:at] + inserted + text[at + deleted :]
        assert tree.text() == text
        assert [p for leaf in tree.parts for p in leaf] == pre.split(text)
        assert tree.n_tokens == len(pre.encoding.encode_ordinary(text)) and tree.n_chars == len(text)


def test_an_edit_touches_few_parts(pre):
    text = "some words in a long text, " * 4000
    tree = TokenTree(text, pre)
    assert tree.edit(50_000, 3, "new") <= 8
    assert len(tree.parts) > 4000 // LEAF


def test_table(spark):
    rows = [
        (1, "one two three", [(4, 3, "2")]), (1, "one two three", [(4, 3, "2")]), (2, None, [(0, 0, "made new")]), (3, "", None), (4, "kept", []),
        (None, "no key", [(2, 1, ""), (0, 100, "all gone")]), (5, "x" * 20_000, [(None, None, None), (99_999, 5, " end")]),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:long,deleted:long,inserted:string>>").selectExpr("*", "'z' as n_tokens")
    pre = PreTokens(PATH, PATTERN)
    want = []
    for key, text, edits in rows:
        before = after = text or ""
        for start, deleted, inserted in edits or []:
            at = min(start or 0, len(after))
            after = after[:at] + (inserted or "") + after[at + (deleted or 0) :]
        size = lambda t: len(pre.encoding.encode_ordinary(t))
        want.append((key, len(before), size(before), len(after), size(after)))
    got = [(r.doc_id, r.n_chars, r.n_tokens, r.n_chars_edited, r.n_tokens_edited) for r in edited_counts(docs, PATH, PATTERN).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert edited_counts(docs.limit(0), PATH, PATTERN).count() == 0


def test_stored_trees_follow_edits_in_several_runs(spark, tmp_path):
    rng = random.Random(11)
    texts = {k: "".join(rng.choices(ALPHABET, k=rng.choice([0, 5, 400]))) for k in range(12)} | {12: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    size = PreTokens(PATH, PATTERN).encoding.encode_ordinary
    trees, now = token_trees(docs, PATH, PATTERN), {k: t or "" for k, t in texts.items()}
    for run in range(2):
        trees.select("doc_id", "text", "chars", "tokens").write.parquet(f"{tmp_path}/{run}")
        rows = []
        for key in range(0, 12, 2):
            for seq in range(3):
                at, gone, new = rng.randrange(len(now[key]) + 1), rng.randrange(4), "".join(rng.choices(ALPHABET, k=3))
                rows.append((key, seq, at, gone, new))
                now[key] = now[key][:at] + new + now[key][at + gone :]
        edits = spark.createDataFrame(rows, "doc_id long, seq long, start long, deleted long, inserted string")
        trees = edit_trees(spark.read.parquet(f"{tmp_path}/{run}"), edits, PATH, PATTERN)
        got = {r.doc_id: (r.text, r.n_tokens, sum(r.tokens), r.n_recounted > 0) for r in trees.collect()}
        assert got == {k: (t, len(size(t)), len(size(t)), k < 12 and k % 2 == 0) for k, t in now.items()}


def test_gathered_edits_follow_their_sequence(spark):
    edits = spark.createDataFrame([(1, 2, 0, 1, "b"), (1, 1, 0, 0, "a"), (2, 1, 5, 0, "c")], "doc_id long, seq long, start long, deleted long, inserted string")
    got = {r.doc_id: [e.inserted for e in r.edits] for r in gather_edits(edits).collect()}
    assert got == {1: ["a", "b"], 2: ["c"]}


def test_query_over_a_whole_table(spark, sf_dir):
    from strataloom.llm.queries import op5_token_counts

    pre = PreTokens(PATH, PATTERN)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op5_token_counts(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for row in got:
        t = texts[row.doc_id]
        n = len(t)
        for start, deleted, inserted in ((n // 3, 4, " edited"), (n // 2, 40, ""), (n, 0, "\nOne line more, 2 words.")):
            at = min(start, len(t))
            t = t[:at] + inserted + t[at + deleted :]
        assert row.n_tokens == len(pre.encoding.encode_ordinary(texts[row.doc_id]))
        assert (row.n_tokens_edited, row.n_chars_edited) == (len(pre.encoding.encode_ordinary(t)), len(t))
