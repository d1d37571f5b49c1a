"""Quality rules and line dedup against plain Python, and the SQL twins on whole tables."""

import re
from collections import Counter, defaultdict

import pytest

from strataloom.llm import common, host_rules, line_dedup
from strataloom.llm import queries as Q
from strataloom.llm.host_rules import apply_rules, host_verdicts
from strataloom.llm.line_dedup import drop_boilerplate
from tests.comparing import duck_rows, spark_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = " \t\x0b\x0c\r"


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_sql_twin(spark, sf_dir, name):
    assert spark_rows(Q.queries()[name](spark, sf_dir)) == duck_rows(Q.oracle_sql()[name], sf_dir)


def figures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_figures_of_odd_texts(spark):
    texts = [None, "", " \n\t ", "a", "a b", "a b c a b c", "x x x x x", "# * $\n# * $\n\n\n", "é ü é ü é ü é ü", "a\r\nb\r\na\r\nb", "word " * 30_000, "1 2 3 9 1 2 3 9 9"]
    docs = spark.createDataFrame([(i, "s", t, "z") for i, t in enumerate(texts)], "doc_id long, source string, text string, n_words string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in apply_rules(docs).collect()}
    assert got == {i: figures(t) for i, t in enumerate(texts)}


def test_figures_where_places_need_more_bits(spark, monkeypatch):
    monkeypatch.setattr(host_rules, "PLACE_BITS", 3)
    texts = ["a b c", "a b c a b c a b c", "p q r s p q r t p q r s u", "x " * 100, None]
    docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in apply_rules(docs).collect()}
    assert got == {i: figures(t) for i, t in enumerate(texts)}


def test_host_verdict_reaches_its_documents(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short text"
    rows = [(i, "mill", bad if i < 95 else good) for i in range(100)] + [(100 + i, "press", good) for i in range(100)] + [(300, None, good), (300, None, good), (None, "press", bad)]
    got = apply_rules(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    kept = {(r.doc_id, r.kept) for r in got}
    assert len(got) == len(rows)
    assert all((i, False) in kept for i in range(100)) and all((100 + i, True) in kept for i in range(100))
    assert (300, True) in kept and (None, False) in kept


def test_small_hosts_shrink_to_the_mean(spark):
    rows = [("one", True)] + [("big", False)] * 999
    got = {r.host: r for r in host_verdicts(spark.createDataFrame(rows, "source string, base_failed boolean")).collect()}
    assert got["one"].n_failed == 1 and got["one"].rate < 1 and got["big"].host_ok


def test_rules_of_an_empty_table(spark):
    assert apply_rules(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def stripped(rows, ratio=0.1, least=5):
    pages, having = Counter(h for _, h, _ in rows), defaultdict(Counter)
    for _, host, text in rows:
        having[host].update({x for x in (line.strip(BLANKS) for line in (text or "").split("\n")) if x})
    out = []
    for key, host, text in rows:
        lines = (text or "").split("\n")
        often = lambda line: having[host][line.strip(BLANKS)] >= least and having[host][line.strip(BLANKS)] > ratio * pages[host]  # noqa: B023, E731
        kept = [line for line in lines if not often(line)]
        out.append((key, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_lines_against_plain_python(spark):
    rows = [(i, "a", f"Menu\nown line {i}\n  Menu \n\nFooter") for i in range(30)]
    rows += [(100 + i, "b", f"Menu\ntext {i}" if i < 4 else f"text {i}") for i in range(40)]
    rows += [(200, None, "Menu"), (201, None, None), (202, "c", ""), (203, "c", "\n\n"), (1, "a", "Menu\nMenu\nnew")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as lines", "2 as host", "3 as lines_total")
    got = drop_boilerplate(docs)
    assert got.columns == [*docs.columns, "lines_dropped"]
    assert sorted(((r.doc_id, r.text, r.lines_total, r.lines_dropped) for r in got.collect()), key=repr) == stripped(rows)


def test_lines_where_the_table_is_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rows = [(i, "big" if i % 3 else None, f"own {i}\nmenu\nfooter {i % 2}") for i in range(90)] + [(100, "small", "menu\nonly"), (101, "small", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r.text for r in drop_boilerplate(docs).collect()}
    assert got == {i: f"own {i}" for i in range(90)} | {100: "menu\nonly", 101: ""}


def test_lines_of_an_empty_table(spark):
    assert drop_boilerplate(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
