"""Operators, sources, sinks and streams on small tables."""

import random
from math import comb

import pytest
from pyspark.sql import functions as F

from strataloom.operators import graph as G
from strataloom.operators import statistics as S
from strataloom.operators import tables as T
from strataloom.sources import readers as R
from strataloom.sources import writers as W
from strataloom.streaming import stateful


def test_exact_mcnemar(spark):
    rng = random.Random(1)
    pairs = [(0, 0), (1, 0), (0, 9), (5, 5), (400, 450)] + [(rng.randint(0, 20), rng.randint(0, 20)) for _ in range(30)]
    rows = spark.createDataFrame(pairs, "a long, b long").select("a", "b", S.exact_mcnemar(F.col("a"), F.col("b")).alias("p")).collect()
    for r in rows:
        n, k = r.a + r.b, min(r.a, r.b)
        want = min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0
        assert r.p == pytest.approx(want, rel=1e-9)


def test_holm_runs_within_families(spark):
    rows = spark.createDataFrame([("x", 0.01), ("x", 0.04), ("x", 0.03), ("y", 0.5)], "family string, p_value double")
    got = sorted((r.family, r.p_value, round(r.p_adjusted, 9)) for r in S.holm(rows, by=("family",)).collect())
    assert got == [("x", 0.01, 0.03), ("x", 0.03, 0.06), ("x", 0.04, 0.06), ("y", 0.5, 0.5)]


def test_wilson_without_trials(spark):
    low, high = S.wilson(F.col("s"), F.col("n"))
    got = spark.createDataFrame([(0, 0), (0, 10), (10, 10)], "s long, n long").select(low.alias("low"), high.alias("high")).collect()
    assert got[0].low is None and got[0].high is None
    assert got[1].low == pytest.approx(0, abs=1e-12) and got[2].high == pytest.approx(1) and 0.2 < got[1].high < 0.35


def test_closure(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (9, 1)], "from_id long, to_id long")
    got = sorted(tuple(r) for r in G.closure(links, spark.createDataFrame([(1,)], "node long"), 3).collect())
    assert got == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_as_of_and_sessions(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3), ("a", 3, 4)], "k string, t long, id long")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 3, "y"), ("b", 10, "z")], "k string, t long, v string")
    assert sorted((r.id, r.v_as_of) for r in T.as_of(left, right, "k", "t", "v").collect()) == [(1, "y"), (2, None), (3, None), (4, "y")]
    events = spark.sql("select * from values ('u', timestamp'2024-01-01 00:00:00', 1), ('u', timestamp'2024-01-01 00:10:00', 2), ('u', timestamp'2024-01-01 01:00:00', 3) as e(u, t, id)")
    assert sorted((r.session, r.n) for r in T.gap_sessions(events, "u", "t", "id", 30).collect()) == [(1, 2), (2, 1)]


def test_samples_and_fingerprints(spark):
    table = spark.createDataFrame([(i, "ab"[i % 2], None if i % 7 else "") for i in range(100)], "id long, g string, v string")
    sample = [tuple(r) for r in T.stratified_sample(table, "g", "id", 5).orderBy("id").collect()]
    assert len(sample) == 10 and sample == [tuple(r) for r in T.stratified_sample(table.repartition(7), "g", "id", 5).orderBy("id").collect()]
    prints = [T.fingerprint(t, ["id", "v"]).first() for t in (table, table.repartition(5), table.withColumn("v", F.coalesce("v", F.lit(""))), table.limit(0))]
    assert prints[0] == prints[1] and prints[0] != prints[2] and prints[3].n_rows == 0


def test_records_make_a_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1", "https://a.example", "A", "text\nmore", "h", None), ("2", "https://b.example", None, "", "h2", "web")], R.RECORD)
    W.write_records(rows, str(tmp_path / "json"))
    assert sorted(map(tuple, R.read_records(spark, str(tmp_path / "json")).collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    W.write_table(rows.withColumn("tags", F.array(F.lit("x"))), str(tmp_path / "csv"), "csv")
    back = R.read_delimited(spark, str(tmp_path / "csv"))
    assert back.count() == 2 and {r.tags for r in back.collect()} == {'["x"]'}
    (tmp_path / "mixed").mkdir()
    (tmp_path / "mixed" / "r.ndjson").write_text('{"document_id": "1"}\n\n[1, 2]\nnot json\n')
    assert [r.document_id for r in R.read_records(spark, str(tmp_path / "mixed"), strict=False).collect() if r.document_id] == ["1"]


def test_first_wins_and_vector_records(spark):
    rows = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), (None, 3, "c"), (None, 4, None)], "key string, seq long, v string")
    assert sorted((r.key or "", r.v or "") for r in W.first_wins(rows, "key", ["seq"]).collect()) == [("", ""), ("", "c"), ("k", "a")]
    assert W.vector_records(rows, "seq", "v", ["key", "v"]).where("id = '4'").first().metadata == "{}"


def test_feeds_maps_and_transcripts(spark, tmp_path):
    rss = "<rss><channel><title>T</title><item><title><![CDATA[One & two]]></title><link>https://a.example/1</link><guid>g1</guid><description>d</description><pubDate>Mon</pubDate></item></channel></rss>"
    atom = '<feed><entry><title>Two</title><link rel="x" href="https://a.example/2"/><id>i2</id><summary>s</summary><updated>u</updated></entry></feed>'
    got = sorted(tuple(r) for r in R.parse_feed(spark.createDataFrame([(rss,), (atom,), (None,)], "xml string")).collect())
    assert got == [("g1", "https://a.example/1", "One & two", "d", "Mon"), ("i2", "https://a.example/2", "Two", "s", "u")]
    maps = R.parse_sitemap(spark.createDataFrame([("<sitemapindex><sitemap><loc> https://a.example/m.xml </loc></sitemap></sitemapindex>",), ("<urlset><url><loc>https://a.example/p</loc></url></urlset>",)], "xml string"))
    assert sorted((r.loc, r.is_index) for r in maps.collect()) == [("https://a.example/m.xml", True), ("https://a.example/p", False)]
    vtt = "WEBVTT\n\n00:01.500 --> 00:03.000\n<v Ann>Hello\nthere\n\n1\n01:00:00,000 --> 01:00:02,250 align:left\nBob: Good bye\n"
    cues = R.parse_transcript(spark.createDataFrame([(vtt,)], "text string")).orderBy("index").collect()
    assert [(r["index"], r.start, r.end, r.speaker, r.text) for r in cues] == [(0, 1.5, 3.0, "Ann", "Hello there"), (1, 3600.0, 3602.25, "Bob", "Good bye")]
    (tmp_path / "urls.txt").write_text("# no\nhttps://a.example/x \n\nHTTP://b.example\nftp://c\n")
    assert sorted(r.url for r in R.read_urls(spark, str(tmp_path / "urls.txt")).collect()) == ["HTTP://b.example", "https://a.example/x"]


def test_streams(spark, tmp_path):
    rows = spark.sql("select * from values ('a', timestamp'2024-01-01 00:00:00'), ('a', timestamp'2024-01-01 00:05:00'), ('b', timestamp'2024-01-01 00:00:30'), ('a', timestamp'2024-01-01 02:00:00') as e(k, t)")
    rows.write.parquet(str(tmp_path / "in"))

    def ran(name, make, mode):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        query = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    assert sorted(r.k for r in ran("seen", lambda s: stateful.first_seen(s, "k", "t"), "append")) == ["a", "b"]
    assert sorted((r.k, r.n) for r in ran("counted", lambda s: stateful.windowed_counts(s, "t", "k", "1 hour", "10 minutes"), "complete")) == [("a", 1), ("a", 2), ("b", 1)]
    assert sorted((r.k, r.n) for r in ran("met", lambda s: stateful.sessions(s, "t", "k", "30 minutes", "10 minutes"), "complete")) == [("a", 1), ("a", 2), ("b", 1)]


def test_css_tokens_of_all_style_elements(spark, tmp_path):
    from strataloom.plans.pages import css_tokens

    page = "<style>a{color:red;}</style><p>x</p><STYLE media=print>b{color:red;top:0}</STYLE>"
    spark.createDataFrame([(1, "http://a.example/", page)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(tuple(r) for r in css_tokens(spark, str(tmp_path)).collect()) == [("color:red", 2), ("top:0", 1)]


def test_graph_of_all_entity_types(spark, tmp_path):
    from strataloom.plans import registry

    texts = {1: "ann@a.org wrote the Fast SQL Engine on 2020-01-02", 2: "version 1.2.3 of the JSON docs", 3: None}
    spark.createDataFrame([(k, "s", "en", t) for k, t in texts.items()], "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {n: sorted(tuple(r) for r in registry.queries()[n](spark, str(tmp_path)).collect()) for n in ("entity_agg_all", "graph_edges_all", "graph_cooccurrence_all", "graph_neighbors_all")}
    named = {1: [("date", "2020-01-02"), ("email", "ann@a.org"), ("technical_term", "fast sql engine")], 2: [("technical_term", "json"), ("version", "1.2.3")]}
    ids = {k: [f"entity:{t}:{v}" for t, v in pairs] for k, pairs in named.items()}
    mentions = [(f"document:{k}", x) for k, xs in ids.items() for x in xs]
    assert got["entity_agg_all"] == sorted((t, v, 1, 1) for pairs in named.values() for t, v in pairs)
    assert got["graph_edges_all"] == sorted([("mentions", d, x) for d, x in mentions] + [("contains_document", "source:s", f"document:{k}") for k in texts])
    assert got["graph_cooccurrence_all"] == sorted((a, b, 1) for xs in ids.values() for i, a in enumerate(xs) for b in xs[i + 1 :])
    assert got["graph_neighbors_all"] == sorted((x, "mentions", d) for d, x in mentions)
