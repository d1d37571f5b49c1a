"""The classifier by held-out accuracy, the extractor by unseen labelled pages, the graph by recall."""

import html
import itertools
import zlib

import numpy as np
import pytest

from strataloom.llm.hnsw import build_graph, nearest_neighbours, search_graph
from strataloom.llm.html_text import Field, default_field, extract_pages, leaf_blocks, main_text, train
from strataloom.llm.html_training import labelled_pages
from strataloom.llm.quality import quality_scores

# ---------------------------------------------------------------- quality


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    truth = [(r.quality, got[r.doc_id]) for r in labels.where("quality is not null").collect() if got[r.doc_id].held_out]
    good, bad = ([r.score for q, r in truth if q == k] for k in (1, 0))
    wins = np.mean([(g > b) + 0.5 * (g == b) for g, b in itertools.product(good, bad)])
    assert wins > 0.9, wins
    assert np.mean([q == r.predicted for q, r in truth]) > 0.85


def test_held_out_labels_teach_nothing(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 7 + 1)) for i in range(60)], "doc_id long, text string")
    kind = "doc_id long, quality int"
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    one = spark.createDataFrame([(i, i % 2) for i in range(60)], kind)
    two = spark.createDataFrame([(i, 1 - i % 2 if out(i) else i % 2) for i in range(60)], kind)
    rows = lambda labels: sorted(tuple(r) for r in quality_scores(docs, labels).collect())
    assert rows(one) == rows(two)


def test_scores_of_odd_rows(spark):
    kind = "doc_id long, text string, score string, x int"
    docs = spark.createDataFrame([(1, None, "s", 1), (2, "", None, 2), (None, "abc", "t", 3), (3, "w " * 50_000, "", 4), (3, "w " * 50_000, "", 4)], kind)
    labels = spark.createDataFrame([(2, 1), (2, None), (None, 1)], "doc_id long, quality int")
    got = quality_scores(docs, labels).collect()
    assert len(got) == 5 and {r.score for r in got if r.doc_id in (1, 2)}.__len__() == 1
    none = quality_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_scores(docs.limit(0), labels).count() == 0


# ---------------------------------------------------------------- pages


def test_unseen_pages():
    field, right, wrong = default_field(), 0, 0
    for page in labelled_pages(60, seed=99):
        blocks = leaf_blocks(page)
        wanted = "\n".join(b.text for b in blocks if b.label == "1")
        right += main_text(page, field) == wanted
        wrong += main_text(page, field) != wanted
    assert right / (right + wrong) > 0.85


def test_blocks():
    page = "<p>One <b>two</b>&amp;\n three<p>Four<ul><li>a<li>b</ul><script>if (a < b) x()</script><!-- no --><div>x<br>y</div><a href=/q>go</a>"
    assert [b.text for b in leaf_blocks(page)] == ["One two& three", "Four", "a", "b", "x y", "go"]
    assert leaf_blocks("") == [] and [b.text for b in leaf_blocks("plain < text")] == ["plain < text"]


def test_blocks_after_empty_svg_with_math_and_many_names():
    page = '<p>One.</p><svg class="i"/><p>Two<svg><title>no</title></svg>.</p><svg/><math/><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math>.</p>'
    assert [b.text for b in leaf_blocks(page)] == ["One.", "Two.", "So x=1."]
    (block,) = leaf_blocks(f'<div class="{" ".join("u" + chr(97 + i) for i in range(25))} comments">text</div>')
    assert "name comments" in block.names


def test_viterbi_finds_the_best_path():
    random = np.random.default_rng(0)
    field = Field({f"f{i}": random.normal(size=2) for i in range(6)}, random.normal(size=(2, 2)))
    rows = [[f"f{i}" for i in random.integers(0, 6, 2)] for _ in range(8)]

    def score(states):
        own = sum(field.unary[f][s] for row, s in zip(rows, states, strict=True) for f in row)
        return own + sum(field.moves[a, b] for a, b in itertools.pairwise(states))

    best = max(itertools.product((0, 1), repeat=8), key=score)
    assert field.decode(rows).tolist() == list(best)


def test_training_separates_states():
    pages = [([["any", "x"], ["any", "x"], ["any", "y"]], [1, 1, 0])] * 20
    assert train(pages, steps=60).decode([["any", "x"], ["any", "x"], ["any", "y"]]).tolist() == [1, 1, 0]


def test_pages_of_odd_kinds(spark):
    long = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article>" + "<p>A sentence of an article, with words. And one more.</p>" * 3000 + "</article></body></html>"
    rows = [(1, "u", None, "a"), (2, None, "", "b"), (None, "v", long, "c"), (4, "w", "<p>unclosed <b", "d"), (4, "w", "<p>unclosed <b", "d")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r for r in got}
    assert by[1].text == "" and by[2].text == "" and by[None].text.count("\n") == 2999 and "Home" not in by[None].text


def test_pages_hold_no_markup(spark, sf_dir):
    from strataloom.llm.queries import op1_html_extraction

    for r in op1_html_extraction(spark, sf_dir).collect():
        assert "<script" not in r.text and "  " not in r.text and html.unescape(r.text.replace("&", "")) == r.text.replace("&", "")


# ---------------------------------------------------------------- neighbours


def exact(rows, every=50, k=5):
    usable = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in usable:
        if q % every == 0:
            found = [(-float(v @ w) / float(np.linalg.norm(v) * np.linalg.norm(w)), i) for i, w in usable if i != q and len(w) == len(v)]
            out[q] = sorted(found)[:k]
    return out


def recall(got, want):
    """By score, so that ties count."""
    hits = total = 0
    for q, best in want.items():
        least = -best[-1][0] - 1e-9 if best else 0
        hits += sum(r.score >= least for r in got if r.query_id == q)
        total += len(best)
    return hits / total


def test_recall_on_a_whole_table(spark, sf_dir):
    for folder in (sf_dir, "/root/testdata/sf0.01"):
        rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
        got = nearest_neighbours(spark.read.parquet(f"{folder}/embeddings.parquet")).collect()
        want = exact(rows)
        assert recall(got, want) >= 0.9
        vectors = {i: np.array(v, float) for i, v in rows}
        for r in got:
            a, b = vectors[r.query_id], vectors[r.vec_id]
            assert r.query_id != r.vec_id and r.score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)
        for q in want:
            own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
            assert [r["rank"] for r in own] == list(range(1, len(want[q]) + 1))
            assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)


def test_vectors_of_odd_kinds(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, None), (5, [None, 1.0]), (6, [2.0, 0.0]), (7, [1.0, 1.0]), (8, [2.0, 0.0]), (50, [0.0, 0.0]), (100, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = [(r.query_id, r["rank"], r.vec_id) for r in nearest_neighbours(vectors).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 6), (0, 2, 8), (0, 3, 7)]
    assert nearest_neighbours(vectors.limit(0)).count() == 0


def test_recall_in_several_shards(spark):
    random = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(random.normal(size=(1500, 24)))]
    rows += [(2000 + i, rows[50][1]) for i in range(30)]
    got = nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert recall(got, exact(rows)) >= 0.9
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 50), key=lambda r: r["rank"])] == [2000, 2001, 2002, 2003, 2004]


def test_graph_keeps_flat_rows():
    units = np.random.default_rng(1).normal(size=(700, 16)).astype(np.float32)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    levels = build_graph(units)
    assert len(levels[0][0]) == 700 and all(flat.shape[0] == len(nodes) for nodes, flat in levels)
    found, _ = search_graph(units, levels, units[:50])
    assert (found[:, 0] == np.arange(50)).all()
