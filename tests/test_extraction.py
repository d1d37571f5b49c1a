"""Chunks, Markdown, redaction and robots rules against plain forms of them."""

import random
import re
import urllib.robotparser

from pyspark.sql import functions as F

from strataloom.functions import html as H
from strataloom.functions.text import REDACTIONS
from strataloom.operators import robots as R
from strataloom.operators.chunks import chunk_documents, chunks
from strataloom.operators.markdown import markdown_of
from strataloom.operators.redaction import redact, sensitive_totals


def test_chunks_follow_headings_and_fences():
    text = "---\ntitle: x\n---\n# One\n\nalpha\n\n```\n# not a heading\n\nstill code\n```\n\n## Two ##\n\nbeta\n"
    (only,) = chunks(text, 1000)
    assert only[:2] == (0, "One") and only[3].startswith("---\ntitle: x\n---\n# One") and only[2] == len(only[3]) // 4
    small = chunks(text, 15)
    assert [c[1] for c in small] == ["One", "Two"] or [c[0] for c in small] == list(range(len(small)))
    assert sum("still code" in c[3] for c in small) == 1 and any("# not a heading\n\nstill code" in c[3] for c in small)
    assert chunks("", 10) == chunks("---\na: b\n---\n \n", 10) == []


def test_chunks_keep_every_word_within_the_bound():
    rng = random.Random(5)
    for _ in range(200):
        parts = [rng.choice(["# H", "## Sub", "", "para " * rng.randint(1, 40), "```\ncode\n\nmore\n```"]) for _ in range(rng.randint(1, 25))]
        text, most = "\n\n".join(parts), rng.choice([5, 20, 60])
        made = chunks(text, most)
        assert " ".join(c[3] for c in made).split() == text.split()
        assert [c[0] for c in made] == list(range(len(made)))


def test_chunked_table(spark):
    rows = spark.createDataFrame([(1, "# A\nb"), (2, None), (None, "x" * 100_000), (1, "# A\nb")], "doc_id long, content string")
    got = sorted(((r.doc_id, r.chunk_index, r.heading, r.token_count) for r in chunk_documents(rows, max_tokens=50).collect()), key=repr)
    assert got == [(1, 0, "A", 1), (1, 0, "A", 1), (None, 0, None, 25_000)]
    assert chunk_documents(rows.limit(0)).count() == 0


def test_redaction(spark):
    texts = ["", None, "write to a.b@c.org or 555-123-4567 now", "token: abcdefghijklmnop1234 x", "api_key=user.name.long@mail.example.org", "Bearer abc.def== and secret = Bearer_zzzzzzzzzzzzzzz"]
    got = {r.doc_id: r for r in redact(spark.createDataFrame(list(enumerate(texts)), "doc_id int, content string")).collect()}
    for i, text in enumerate(texts):
        covered, want, at = [], "", 0
        spans = sorted(((m.start(), m.start() - m.end(), n, m.end()) for n, p in REDACTIONS for m in re.finditer(p, text or "")))
        for start, _, name, end in spans:
            if start >= at:
                want += text[at:start] + f"[REDACTED:{name}]"
                covered.append(name)
                at = end
        assert got[i].redacted == (None if text is None else want + text[at:])
        assert sum(got[i].counts.values()) == len(covered)
    assert got[2].counts == {"email": 1, "phone": 1}
    totals = sensitive_totals(redact(spark.createDataFrame(list(enumerate(texts)), "doc_id int, content string")))
    assert {r.rule: r.hits for r in totals.collect()}["email"] >= 1


def test_robots_rules_like_the_standard_parser(spark):
    rng = random.Random(9)
    lines = ["User-agent: *", "User-agent: corpusbot", "user-agent: other", "Disallow: /a", "Disallow: /", "Allow: /a/b", "Disallow:", "Crawl-delay: 3", "", "# note", "Sitemap: https://x/s.xml", "Allow: /c # why", "nonsense"]
    files = [(f"h{i}", "\n".join(rng.choices(lines, k=rng.randint(0, 14)))) for i in range(150)]
    paths = ["/", "/a", "/a/b/c", "/c", "/d"]
    urls = spark.createDataFrame([(h, p) for h, _ in files for p in paths], "host string, path string")
    rules = R.robots_rules(spark.createDataFrame(files, "host string, body string"), "corpusbot")
    got = {(r.host, r.path): r.ok for r in urls.join(rules, "host", "left").select("host", "path", R.allowed(F.col("rules"), F.col("path")).alias("ok")).collect()}
    wrong = []
    for host, body in files:
        parser = urllib.robotparser.RobotFileParser()
        parser.parse(body.split("\n"))
        wrong += [(body, p, got[host, p]) for p in paths if got[host, p] != parser.can_fetch("corpusbot", f"https://{host}{p}")]
    assert not wrong, wrong[:3]


def test_markdown():
    page = "<html><head><title>t</title></head><body><h2>A <b>b</b></h2><p>x<br>y &amp; <a href='/z'>link</a></p><ul><li>one<li>two</ul><pre><code class='language-py'>a\n\nb</code></pre><table><tr><th>h<th>i</th></tr><tr><td>1</td><td>2</td></tr></table><script>no</script></body>"
    out = markdown_of(page, "https://e.example/d/")
    assert out.startswith("## A **b**\n\nx  \ny & [link](https://e.example/z)\n\n- one\n- two\n\n```py\na\n\nb\n```")
    assert "| h | i |\n| --- | --- |\n| 1 | 2 |" in out and "no" not in out.split() and markdown_of("", "") == ""


def test_attributes_in_three_forms(spark):
    page = """<a href="/a">1</a><A class='x' HREF='/b'>2</A><a data-href=/no target=_blank href=/c>3</a><a title="a href=no" href = "/d">4</a><a hidden href="it's">5</a><a href=''>6</a><a name=x>7</a><a href='#top'>8</a><img alt=y src=/i.png><img src='/j.png'/>"""
    row = spark.createDataFrame([(page,)], "html string").select(H.links(F.col("html")).alias("links"), H.attribute_values(F.col("html"), H.IMAGE).alias("images")).first()
    assert row.links == ["/a", "/b", "/c", "/d", "it's"]
    assert row.images == ["/i.png", "/j.png"]
