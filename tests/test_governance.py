"""Rights, digests, JSON checks, refreshes and metadata against plain computations and literal rows."""

import hashlib
import itertools
import json
import random

from pyspark.sql import functions as F

from strataloom.functions import metadata as D
from strataloom.operators import digests as H
from strataloom.operators import refresh as X
from strataloom.operators import rights as R
from strataloom.operators import schemas as J

# ---------------------------------------------------------------- rights


def test_meet_of_all_statuses(spark):
    names = ["allowed", "allowed_with_conditions", "denied", "unknown"]
    groups = [(g, s) for g, some in enumerate(c for n in range(1, 5) for c in itertools.combinations(names, n)) for s in some]
    got = {r.g: r.s for r in spark.createDataFrame(groups, "g int, s string").groupBy("g").agg(R.met(F.col("s")).alias("s")).collect()}
    for g, found in got.items():
        some = {s for h, s in groups if h == g} - {"unknown"}
        want = "unknown" if not some else "denied" if "denied" in some else "allowed_with_conditions" if "allowed_with_conditions" in some else "allowed"
        assert found == want
    spelled = [("Yes ", "allowed"), ("permitted-with conditions", "allowed_with_conditions"), ("FALSE", "denied"), ("maybe", "unknown"), (None, "unknown"), ("", "unknown")]
    assert all(r.s == r.want for r in spark.createDataFrame(spelled, "v string, want string").select("want", R.status(F.col("v")).alias("s")).collect())


def test_manifest_and_what_a_pack_says_itself(spark):
    kind = "pack string, content string, license_hint string, host string, internal_indexing string, redistribution string, model_training string, eval_generation string, obligations array<string>"
    rows = [
        ("p", "write to a@b.example", "MIT", "h1", "yes", "denied", None, "conditional", [" cite ", ""]),
        ("p", "the API key is here", " ", "h2", None, "allowed", None, "allowed", None),
        ("q", "plain", "A", "h1", "allowed", "allowed", "allowed", "allowed", ["x"]),
        ("q", "plain", "B", None, "allowed", None, None, None, ["x", None]),
        (None, "plain", None, None, None, None, None, None, None),
    ]
    records = spark.createDataFrame(rows, kind)
    said = spark.createDataFrame([("q", "denied", None, None, None, ["own"])], "pack string, internal_indexing string, redistribution string, model_training string, eval_generation string, obligations array<string>")
    got = {r.pack: r for r in R.rights_manifest(records, "pack", said).collect()}
    p, q, none = got["p"], got["q"], got[None]
    assert (p.internal_indexing, p.redistribution, p.model_training, p.eval_generation, p.rights_status) == ("allowed", "denied", "unknown", "allowed_with_conditions", "permissioned")
    assert (p.obligations, p.source_domains, p.license_hints, p.detected_license, p.pii_risk, p.sensitive_data_risk) == (["cite"], ["h1", "h2"], ["MIT"], "MIT", "medium", "medium")
    assert (q.internal_indexing, q.redistribution, q.rights_status, q.obligations, q.detected_license) == ("denied", "unknown", "unknown", ["own", "x"], None)
    assert (none.rights_status, none.obligations, none.pii_risk) == ("unknown", [], "low")


def test_rights_along_derivations(spark):
    draw = random.Random(2)
    spelled = ["allowed", "allowed_with_conditions", "denied", None]
    rows = [(i, *(draw.choice(spelled) for _ in R.USES)) for i in range(60)]
    links = [(i, i - 1) for i in range(1, 20)] + [(30, 31), (31, 32), (32, 30), (30, 5)] + [(draw.randrange(40, 60), draw.randrange(60)) for _ in range(15)] + [(7, None), (8, 8), (9, 999)]
    got = R.effective_rights(spark.createDataFrame(rows, "id int, " + ", ".join(f"{u} string" for u in R.USES)), spark.createDataFrame(links, "child int, parent int"), "id").collect()
    for r in got:
        above, todo = {r.id}, [r.id]
        while todo:
            child = todo.pop()
            more = {p for c, p in links if c == child and p is not None and p < 60} - above
            above |= more
            todo += more
        for n, use in enumerate(R.USES, 1):
            some = {rows[i][n] for i in above} - {None}
            assert r[use] == ("denied" if "denied" in some else "allowed_with_conditions" if "allowed_with_conditions" in some else "allowed" if some else "unknown")
    assert len(got) == 60


# ---------------------------------------------------------------- digests


def tree(values, block):
    while True:
        values = [hashlib.sha256("\n".join(values[i : i + block]).encode()).hexdigest() for i in range(0, len(values), block)]
        if len(values) == 1:
            return values[0]


def test_trees_equal_the_sequence(spark):
    rows = [(g, f"{i:05d}", None if i % 7 == 3 else f"välue {i}") for g, n in (("a", 1), ("b", 4), ("c", 5), ("d", 700), (None, 16)) for i in range(n)]
    random.Random(1).shuffle(rows)
    got = {r.g: (r.entries, r.root) for r in H.tree_digests(spark.createDataFrame(rows, "g string, k string, v string"), "g", ["k"], "v", 4).collect()}
    want = {}
    for g in ("a", "b", "c", "d", None):
        own = [v or "" for _, _, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1])]
        want[g] = (len(own), tree(own, 4))
    assert got == want
    assert H.tree_digests(spark.createDataFrame([], "g string, k string, v string"), "g", ["k"], "v").count() == 0


def test_list_digest_is_that_of_canonical_json(spark):
    entries = [("p", "é/ü.md", "a" * 64, 3), ("p", 'q"\\.md', "b" * 64, 10**12), ("p", "🙂.md", "c" * 64, 0), ("r", "x", "d", None)]
    frame = spark.createDataFrame(entries, "g string, path string, sha string, size long")
    entry = H.ascii_json(H.canonical_entry(size=F.col("size"), path=F.col("path"), sha256=F.col("sha")))
    got = {r.g: (r.entries, r.root_hash) for r in H.list_digests(frame.select("g", "path", entry.alias("e")), "g", "path", "e").collect()}
    for g in ("p", "r"):
        own = sorted(({"path": p, "sha256": s, "size": n} for h, p, s, n in entries if h == g), key=lambda e: e["path"])
        text = json.dumps(own, sort_keys=True, separators=(",", ":"), ensure_ascii=True)
        assert got[g] == (len(own), hashlib.sha256(text.encode()).hexdigest())


# ---------------------------------------------------------------- JSON checks


def kind_of(v):
    return "null" if v is None else "boolean" if isinstance(v, bool) else "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "string" if isinstance(v, str) else "integer" if isinstance(v, int) else "number"


def wrong(v, schema, path="$"):
    """What the subset asks for, walked by hand."""
    kind, expected = kind_of(v), schema.get("type")
    fits = lambda t: kind in ("integer", "number") if t == "number" else kind == t
    if expected is not None and not any(map(fits, expected if isinstance(expected, list) else [expected])):
        return [f"{path}: expected {expected}, got {kind}"]
    out = []
    if "enum" in schema and not any(v == e and kind_of(e) in (kind, "integer", "number") for e in schema["enum"]):
        out.append(f"{path}: value is not in enum")
    if kind in ("integer", "number"):
        out += [f"{path}: value is below minimum {schema['minimum']}"] if v < schema.get("minimum", v) else []
        out += [f"{path}: value is above maximum {schema['maximum']}"] if v > schema.get("maximum", v) else []
    if kind == "object":
        out += [f"{path}.{k}: required property is missing" for k in schema.get("required", []) if k not in v]
        known = schema.get("properties", {})
        out += [f"{path}.{k}: additional property is not allowed" for k in v if k not in known] if schema.get("additionalProperties") is False else []
        for k, child in known.items():
            out += wrong(v[k], child, f"{path}.{k}") if k in v else []
    if kind == "array" and "items" in schema:
        for i, x in enumerate(v):
            out += wrong(x, schema["items"], f"{path}[{i}]")
    return out


SCHEMA = {
    "type": "object", "required": ["name", "odd key"], "additionalProperties": False,
    "properties": {
        "name": {"type": "string", "enum": ["a", "b"]}, "odd key": {"type": ["integer", "null"], "minimum": 0}, "score": {"type": "number", "maximum": 1.5},
        "flags": {"type": "array", "items": {"type": "boolean"}}, "tree": {"type": "object", "properties": {"kids": {"type": "array", "items": {"type": "array", "items": {"type": "integer", "maximum": 3}}}}},
        "any": {"enum": [1, "x", None, [1, 2], {"k": "v"}]},
    },
}


def test_schema_issues(spark):
    draw = random.Random(6)
    leaf = lambda: draw.choice([None, True, False, 0, 1, -1, 4, 1.0, 1.25, 2.5, 10**25, "a", "x", [], [1, 2], {"k": "v"}, [True, 1], {"kids": [[1, 5], [2, "q"], 7]}, {}])
    values = [leaf() for _ in range(25)] + [{k: leaf() for k in draw.sample(["name", "odd key", "score", "flags", "tree", "any", "more", "x.y"], draw.randint(0, 8))} for _ in range(300)]
    values += [{"name": "a", "odd key": 3, "score": 1, "flags": [True], "tree": {"kids": [[1], []]}, "any": {"k": "v"}}]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)]
    got = {r.i: (sorted(r.errors), r.valid) for r in J.validated(spark.createDataFrame(rows, "i int, j string"), "j", SCHEMA).collect()}
    for i, v in enumerate(values):
        want = sorted(wrong(v, SCHEMA))
        assert got[i] == (want, not want), rows[i]
    bad = J.validated(spark.createDataFrame([("{",), (None,), ('{"a":1,"a":2}',)], "j string"), "j", {}).collect()
    assert [r.errors for r in bad] == [["$: not readable as JSON"]] * 3
    plan = J.validated(spark.createDataFrame(rows, "i int, j string"), "j", SCHEMA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---------------------------------------------------------------- refreshes


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_refresh_rewrites_what_changed(spark, tmp_path):
    derive = lambda rows: rows.select("id", F.explode(F.split("text", " ")).alias("word"))
    frame = lambda rows: spark.createDataFrame([(i, t, str(hash(t))) for i, t in rows.items()], "id int, text string, digest string")
    rows = {i: f"w{i} x y{i % 3}" for i in range(200)}
    path = str(tmp_path / "graph")
    X.build(frame(rows), path, "id", "digest", derive, 16)
    assert X.status(frame(rows), path, "id", "digest", 16) == "current"
    before = files(tmp_path)
    assert X.refresh(frame(rows), path, "id", "digest", derive, 16).count() == 0 and files(tmp_path) == before
    part = {r.id: r.part for r in frame(rows).select("id", X.part_of("id", 16).alias("part")).collect()}
    gone = next(p for p in range(16) if p != part[0])
    later = {i: t for i, t in rows.items() if part[i] != gone}
    later[0] = "all new words"
    later[1000] = "one more"
    touched = {gone, part[0], frame({1000: ""}).select(X.part_of("id", 16).alias("p")).first().p}
    assert X.status(frame(later), path, "id", "digest", 16) == "stale"
    found = {r.part: (r.added, r.removed, r.changed) for r in X.refresh(frame(later), path, "id", "digest", derive, 16).collect()}
    assert set(found) == touched and sum(map(sum, found.values())) == 2 + sum(part[i] == gone for i in rows)
    same = {p for p, t in files(tmp_path).items() if before.get(p) == t}
    assert {int(p.split("part=")[1].split("/")[0]) for p in set(before) - same} == touched
    got = sorted((r.id, r.word) for r in spark.read.parquet(f"{path}/rows").collect())
    assert got == sorted((i, w) for i, t in later.items() for w in t.split(" "))
    assert X.refresh(frame(later), path, "id", "digest", derive, 16).count() == 0


# ---------------------------------------------------------------- metadata

PAGES = [
    ("<html><head><meta property='og:title' content='OG &amp; more'><meta content=plain property=og:type><meta name='description' content='no'></head></html>", {"title": "OG & more", "type": "plain"}),
    ('<script type="application/ld+json">{"headline": "LD", "author": {"name": "Ann"}, "datePublished": "2024-01-02", "keywords": "a, b,,c", "image": {"url": "u"}}</script><meta property="og:title" content="OG"><meta property="og:image" content="og.png">', {"title": "LD", "author": "Ann", "published_time": "2024-01-02", "keywords": ["a", "b", "c"], "image": "u"}),
    ('<script type="application/ld+json">[{"@type": "x"}, {"headline": ["L1", "L2"], "author": "Bob", "keywords": ["k", 1, null]}]</script><script type="application/ld+json">{broken</script>', {"title": "L1", "author": "Bob", "keywords": ["k", "1"]}),
    ('<div itemscope itemtype="Article"><h1 itemprop="headline">Micro <b>data</h1><span itemprop="author" itemscope><i itemprop="name">Cy</i></span><meta itemprop="description" content="short"></div><meta property="og:title" content="OG">', {"title": "Micro data", "author": "Cy", "description": "short"}),
    ('<meta property="article:tag" content="t1"><meta property="article:tag" content="t2"><meta property="article:author" content="Dee"><meta property="og:url" content="https://a.example/">', {"tags": ["t1", "t2"], "author": "Dee", "canonical_url": "https://a.example/", "title": "fallback"}),
    ("", {"title": "fallback"}),
    (None, {"title": "fallback"}),
]


def test_rich_metadata(spark):
    frame = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(PAGES)], "i int, html string")
    found = D.rich_metadata(F.coalesce("html", F.lit("")), F.lit("fallback"))
    for r in frame.select("i", *(c.alias(name) for name, c in found.items())).collect():
        assert {k: v for k, v in r.asDict().items() if v is not None and k != "i"} == PAGES[r.i][1], PAGES[r.i][0]
