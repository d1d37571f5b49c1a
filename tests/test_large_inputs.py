"""What made queries fail on large tables, each by a small case."""

import random

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from strataloom import lineage
from strataloom.functions import text as T
from strataloom.llm import common, near_dedup
from strataloom.operators import batches as B
from strataloom.operators import chunks, content, grading, markdown, mentions, redaction, rights
from strataloom.plans import contracts
from strataloom.plans import documents as D
from strataloom.streaming import frontier


def test_near_dedup_joins_without_broadcasts(spark, monkeypatch):
    """its own bound, and the same classes where every join is shuffled."""
    assert near_dedup.SENT_BYTES * 3 <= common.BROADCAST_BYTES
    rows = [(i, f"one two three four five six seven eight nine ten {i % 5} eleven twelve thirteen fourteen fifteen") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, near_dedup.near_duplicates(docs).collect()))
    monkeypatch.setattr(near_dedup, "SENT_BYTES", -1)
    assert sorted(map(tuple, near_dedup.near_duplicates(docs).collect())) == want


def test_selectors_are_told_once_while_parsing(spark, monkeypatch):
    """a page is parsed once for both extractions."""
    seen = []
    plain = content.page_elements
    monkeypatch.setattr(content, "page_elements", lambda *a, **k: seen.append(a) or plain(*a, **k))
    content.extract_best(spark.createDataFrame([("u", "<p>x</p>")], "url string, html string"))
    assert len(seen) == 1
    assert [content.matches({"tag": "div", "id": "S:1", "classes": ["b"], "role": None, "label": "Our COOKIE", "hidden": None}, s) for s in ('div[id^="S:"]', ".b", ".c", '[aria-label*="cookie"i]', "main")] == [True, True, False, True, False]


def test_sensitive_counts_as_in_sql(spark, tmp_path):
    """letters beyond ASCII beside a match, and numbers that share a separator."""
    texts = ["\u00e9a.b@x.com", "a@x.com\u00e9 b@y.org", "555-123-4567 555-123-4568", "(555) 123-4567\n555.123.4567,555 123 4569", "\u017fecret: abcdefghijklmnopqrst", "token\x0b= abcdefghijklmnopqrst", "Bearer\x0babc", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = sorted(con.execute(D.SQL["sensitive_counts"]).fetchall())
        flags = con.execute(D.SQL["privacy_flags"]).fetchall()
    assert sorted(map(tuple, D.sensitive_counts(spark, str(tmp_path)).select("rule", "docs", "hits").collect())) == want
    assert list(map(tuple, D.privacy_flags(spark, str(tmp_path)).collect())) == flags
    assert T.as_re2(r"[-.\s]\s+") == r"[-.\t\n\f\r ][\t\n\f\r ]+"


def test_names_of_one_template(spark, monkeypatch):
    """names that begin or end alike are not dealt by what they share."""
    monkeypatch.setattr(mentions, "AUTOMATON_BYTES", 10)
    names = [f"the same long beginning of all names, {i:05} and their end" for i in range(300)]
    dealt = []
    plain = mentions.join_split
    monkeypatch.setattr(mentions, "join_split", lambda rows, side, key, size: dealt.append(side) or plain(rows, side, key, size))
    texts = spark.createDataFrame([(i, f"<p>{names[i]}</p>") for i in range(300)], "doc_id long, content string")
    found = mentions.name_matches(texts, spark.createDataFrame([(n,) for n in names], "name string"))
    assert sorted((r.doc_id, r.name, r["at"]) for r in found.collect()) == [(i, n, 3) for i, n in enumerate(names)]
    assert dealt[0].groupBy("gram").count().agg(F.max("count")).first()[0] == 1


def test_rights_along_a_long_chain(spark, monkeypatch):
    """rounds follow the digits of a chain's length; circles, several parents and chains behind them."""
    draw = random.Random(3)
    n = 400
    said = {i: [draw.choice([None, "yes", "no", "conditional"]) if draw.random() < 0.02 else None for _ in rights.USES] for i in range(n)}
    links = [(i, i - 1) for i in range(1, 200)] + [(200, 210)] + [(i, i - 1) for i in range(201, 211)] + [(i, draw.randrange(max(0, i - 40), n)) for i in range(220, n) for _ in range(draw.choice([1, 1, 1, 2]))] + [(5, 999), (999, 3)]
    bits = {None: 0, "yes": 1, "conditional": 2, "no": 4}
    own = {i: [bits[v] for v in said[i]] for i in said}
    for _ in range(n):
        for c, p in links:
            if c in own and p in own:
                own[c] = [a | b for a, b in zip(own[c], own[p], strict=True)]
    cuts = []
    plain = rights.cut
    monkeypatch.setattr(rights, "cut", lambda df: cuts.append(1) or plain(df))
    records = spark.createDataFrame([(i, *v) for i, v in said.items()], "id int, " + ", ".join(f"{u} string" for u in rights.USES))
    got = rights.effective_rights(records, spark.createDataFrame(links, "child int, parent int"), "id").collect()
    name = lambda b: "denied" if b & 4 else "allowed_with_conditions" if b & 2 else "allowed" if b & 1 else "unknown"
    assert sorted(tuple(r) for r in got) == sorted((i, *map(name, b)) for i, b in own.items())
    assert len(cuts) < 60


def test_entries_touch_the_journal_once_a_batch():
    """calls to the state do not follow the rows."""
    from datetime import datetime
    from types import SimpleNamespace as Row

    class Held:
        def __init__(self):
            self.rows, self.calls = [], 0

        def called(self, rows):
            self.calls += 1
            self.rows = rows

        get = lambda self: iter(self.rows)
        put = lambda self, rows: self.called(rows)
        appendList = lambda self, rows: self.called(self.rows + rows)  # noqa: E731, N815
        clear = lambda self: self.called([])
        exists = lambda self: False
        update = lambda self, value: None

    entries, journal = frontier.Entries(), Held()
    entries.init(Row(getValueState=lambda *a: Held(), getListState=lambda *a: journal, registerTimer=lambda at: None))
    rows = [Row(seq=i % 50, state="processing", error=None, at=datetime(2024, 1, 1)) for i in range(100)]
    (entry,) = entries.handleInputRows(("u",), iter(rows), None)
    assert (entry.attempts, entry.seq, len(journal.rows), journal.calls) == (50, 49, 50, 1)
    list(entries.handleExpiredTimer(("u",), None, Row(getExpiryTimeInMs=lambda: 1 << 60)))
    assert journal.rows == [] and journal.calls == 2


def test_only_records_of_tasks_are_shuffled(spark, sf_dir, monkeypatch):
    """a pack's later records go before contents are shuffled."""
    seen = []
    plain = grading.eval_tasks
    monkeypatch.setattr(contracts.G, "eval_tasks", lambda records, *a, **k: seen.append(records) or plain(records, *a, **k))
    contracts.eval_tasks(spark, sf_dir)
    assert seen[0].groupBy("pack").count().agg(F.max("count")).first()[0] == 10
    assert "WindowGroupLimit" in seen[0]._jdf.queryExecution().executedPlan().toString()



def test_workers_make_objects_of_few_rows(monkeypatch):
    """F8, F9, F11, F13: a batch is gone through in parts."""
    assert [len(p) for p in lineage.slices(pa.array(range(150)))] == [64, 64, 22] and [len(p) for p in lineage.slices(pa.array([]))] == [0]
    for module in (chunks, content, markdown, redaction, B):
        assert module.slices is lineage.slices
