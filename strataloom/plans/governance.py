"""Queries on rights, digests, JSON checks and declared metadata, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataloom.functions import metadata as D
from strataloom.operators import digests as H
from strataloom.operators import rights as R
from strataloom.operators import schemas as J
from strataloom.operators.corpus import corpus
from strataloom.plans.tables import SQL_CORPUS, table

#: What a license line in a document says of the uses of it.
LICENSES = {"apache": "allowed", "mit license": "Permitted", "creative commons": "allowed-with-conditions", "all rights reserved": "denied"}


def _licensed(spark, sf_dir):
    """Documents as records with rights: their license lines decide on redistribution and training, labels on the others."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    text = F.lower(F.coalesce("text", F.lit("")))
    said = F.coalesce(*(F.when(F.contains(text, F.lit(words)), status) for words, status in LICENSES.items()))
    hint = F.coalesce(*(F.when(F.contains(text, F.lit(words)), words) for words in LICENSES))
    marks = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    rows = docs.join(marks, "doc_id", "left")
    return rows.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("pack"), F.coalesce("text", F.lit("")).alias("content"), hint.alias("license_hint"), F.concat(F.coalesce("source", F.lit("")), F.lit(".example")).alias("host"),
        F.when(F.col("toxic") == 1, "no").when(F.col("toxic") == 0, "Yes").alias("internal_indexing"), said.alias("redistribution"), said.alias("model_training"),
        F.when(F.col("quality") == 1, "true").when(F.col("quality") == 0, "conditional").alias("eval_generation"),
        F.array(F.when(said == "allowed-with-conditions", " attribution "), F.when(F.col("toxic") == 1, "review"), F.lit("")).alias("obligations"),
    )


def rights_by_source(spark, sf_dir):
    rows = R.rights_manifest(_licensed(spark, sf_dir), "pack")
    lists = {c: F.array_join(c, ";").alias(c) for c in ("obligations", "source_domains", "license_hints")}
    return rows.select(*(lists.get(c, F.col(c)) for c in rows.columns))


def rights_of_versions(spark, sf_dir):
    """Rights along derivations: a document is taken from the one before it with the same first line."""
    rows = _licensed(spark, sf_dir).withColumn("line", F.left(F.split_part("content", F.lit("\n"), F.lit(1)), F.lit(12)))
    before = F.lag("doc_id").over(Window.partitionBy("line").orderBy("doc_id"))
    derived = rows.select(F.col("doc_id").alias("child"), before.alias("parent"))
    return R.effective_rights(rows, derived, "doc_id")


def record_roots(spark, sf_dir):
    """Digest trees of each source's records, in the order of their addresses."""
    rows = corpus(table(spark, sf_dir, "documents"))
    entry = H.canonical_entry(path=F.col("url"), sha256=F.col("content_hash"), size=F.octet_length("content").cast("long"))
    return H.tree_digests(rows.select("source", "url", entry.alias("entry")), "source", ["url"], "entry", 256)


def record_list_roots(spark, sf_dir):
    """The same entries as one JSON list of each source."""
    rows = corpus(table(spark, sf_dir, "documents"))
    entry = H.ascii_json(H.canonical_entry(path=F.col("url"), sha256=F.col("content_hash"), size=F.octet_length("content").cast("long")))
    return H.list_digests(rows.select("source", "url", entry.alias("entry")), "source", "url", "entry")


PROPS = {"type": "object", "required": ["k", "source"], "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 89, "enum": [*range(0, 60), 95, 99]}}, "additionalProperties": False}
RECORD = {
    "type": "object", "required": ["doc_id", "lang"], "additionalProperties": False,
    "properties": {
        "doc_id": {"type": "integer"}, "lang": {"type": ["string", "null"], "enum": ["en", "de", "fr", None]}, "source": {"type": "string"},
        "lines": {"type": "array", "items": {"type": "object", "properties": {"n": {"type": "integer", "maximum": 120}}}},
    },
}


def event_props_issues(spark, sf_dir):
    """What is wrong with the events' properties."""
    checked = J.validated(table(spark, sf_dir, "events").select("event_id", "props"), "props", PROPS)
    return checked.select("event_id", F.explode("errors").alias("issue"))


def record_schema_issues(spark, sf_dir):
    """What is wrong with documents as JSON records of their lines' lengths."""
    docs = table(spark, sf_dir, "documents").withColumn("t", F.coalesce("text", F.lit("")))
    lines = F.transform(F.split("t", "\n"), lambda x: F.struct(F.length(x).alias("n")))
    record = F.to_json(F.struct("doc_id", "lang", "source", "n_chars", lines.alias("lines")), {"ignoreNullFields": "false"})
    return J.validated(docs.select("doc_id", record.alias("record")), "record", RECORD).select("doc_id", F.explode("errors").alias("issue"))


def rich_metadata(spark, sf_dir):
    """Metadata of documents rendered as pages: even lengths declare JSON-LD, all declare OpenGraph."""
    docs = table(spark, sf_dir, "documents").withColumn("t", F.coalesce("text", F.lit("")))
    line = F.trim(F.regexp_replace(F.left(F.split_part("t", F.lit("\n"), F.lit(1)), F.lit(40)), r"""[<>&"'\\\x00-\x1f]""", ""))
    docs = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.length("t").alias("n"), line.alias("line"))
    tag = lambda name, value: F.concat(F.lit('<meta content="'), value, F.lit(f'" property="{name}">'))
    ld = F.to_json(F.struct(F.concat(F.lit("LD "), "line").alias("headline"), F.struct(F.col("source").alias("name")).alias("author"), F.array("lang", F.lit("page")).alias("keywords")))
    script = F.when(F.col("n") > 900, F.concat(F.lit('<script type="application/ld+json">'), ld, F.lit("</script>"))).otherwise("")
    html = F.concat(F.lit("<html><head>"), tag("og:title", F.col("line")), tag("og:description", F.concat(F.lit("about &amp; "), "line")), tag("article:tag", F.col("lang")), tag("article:tag", F.col("source")), script, F.lit("</head></html>"))
    found = D.rich_metadata(html, F.concat(F.lit("document "), F.col("doc_id")))
    return docs.select("doc_id", found["title"].alias("title"), found["description"].alias("description"), found["author"].alias("author"), F.array_join(found["tags"], ",").alias("tags"), F.array_join(found["keywords"], ",").alias("keywords"))


QUERIES = [rights_by_source, rights_of_versions, record_roots, record_list_roots, event_props_issues, record_schema_issues, rich_metadata]

_SAID = "CASE " + " ".join(f"WHEN contains(lower(content), '{w}') THEN {({'allowed': 1, 'Permitted': 1, 'allowed-with-conditions': 2, 'denied': 4}[s])}" for w, s in LICENSES.items()) + " ELSE 0 END"
_HINT = "CASE " + " ".join(f"WHEN contains(lower(content), '{w}') THEN '{w}'" for w in LICENSES) + " END"
_NAMED = lambda b: f"CASE WHEN {b} & 4 > 0 THEN 'denied' WHEN {b} & 2 > 0 THEN 'allowed_with_conditions' WHEN {b} & 1 > 0 THEN 'allowed' ELSE 'unknown' END"
_LICENSED = f"""WITH marks AS (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY 1),
  d AS (SELECT documents.doc_id, coalesce(source, '') AS pack, coalesce(text, '') AS content, toxic, quality FROM documents LEFT JOIN marks USING (doc_id)),
  r AS (SELECT doc_id, pack, content, {_HINT} AS hint, toxic, CASE toxic WHEN 1 THEN 4 WHEN 0 THEN 1 ELSE 0 END AS a, {_SAID} AS b, CASE quality WHEN 1 THEN 1 WHEN 0 THEN 2 ELSE 0 END AS c FROM d)"""
_ENTRY = """'{"path":' || to_json(url) || ',"sha256":"' || content_hash || '","size":' || strlen(content) || '}'"""
_SORTED = """row_number() OVER (PARTITION BY source ORDER BY encode(url)) - 1 AS place"""

SQL = {
    "rights_by_source": f"""{_LICENSED}, p AS (SELECT pack, count(*) AS records, bit_or(a) AS a, bit_or(b) AS b, bit_or(c) AS c, bool_or(regexp_matches(content, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}\\b')) AS pii,
        bool_or(regexp_matches(content, '(?i)\\b(?:api[_ -]?key|secret|password|private[_ -]?key|bearer\\s+[A-Za-z0-9._-]+|ssn)\\b')) AS sensitive, array_to_string(list_sort(list(DISTINCT hint) FILTER (hint IS NOT NULL)), ';') AS hints,
        count(DISTINCT hint) AS n_hints, max(hint) AS one, max(b = 2) AS cond, max(toxic) AS toxic FROM r GROUP BY 1)
      SELECT pack, records, {_NAMED('a')} AS internal_indexing, {_NAMED('b')} AS redistribution, {_NAMED('b')} AS model_training, {_NAMED('c')} AS eval_generation,
        CASE WHEN (a & 4 = 0 AND a > 0) OR (b & 4 = 0 AND b > 0) OR c > 0 THEN 'permissioned' ELSE 'unknown' END AS rights_status,
        array_to_string(list_filter([CASE WHEN cond THEN 'attribution' END, CASE WHEN toxic = 1 THEN 'review' END], lambda x: x IS NOT NULL), ';') AS obligations,
        pack || '.example' AS source_domains, coalesce(hints, '') AS license_hints, CASE WHEN n_hints = 1 THEN one END AS detected_license,
        CASE WHEN pii THEN 'medium' ELSE 'low' END AS pii_risk, CASE WHEN sensitive THEN 'medium' ELSE 'low' END AS sensitive_data_risk FROM p""",
    "rights_of_versions": f"""{_LICENSED}, o AS (SELECT doc_id, bit_or(a) OVER w AS a, bit_or(b) OVER w AS b, bit_or(c) OVER w AS c FROM r
        WINDOW w AS (PARTITION BY substring(split_part(content, chr(10), 1), 1, 12) ORDER BY doc_id ROWS UNBOUNDED PRECEDING))
      SELECT doc_id, {_NAMED('a')} AS internal_indexing, {_NAMED('b')} AS redistribution, {_NAMED('b')} AS model_training, {_NAMED('c')} AS eval_generation FROM o""",
    "record_roots": f"""WITH {SQL_CORPUS}, e AS (SELECT source, {_SORTED}, {_ENTRY} AS entry FROM corpus),
      one AS (SELECT source, place // 256 AS place, count(*) AS n, sha256(string_agg(entry, chr(10) ORDER BY place)) AS h FROM e GROUP BY 1, 2),
      two AS (SELECT source, sum(n)::BIGINT AS entries, count(*) AS blocks, first(h ORDER BY place) AS h, sha256(string_agg(h, chr(10) ORDER BY place)) AS top FROM one GROUP BY 1)
      SELECT source, entries, CASE WHEN blocks = 1 THEN h ELSE top END AS root FROM two""",
    "record_list_roots": f"""WITH {SQL_CORPUS}, e AS (SELECT source, {_SORTED}, {_ENTRY} AS entry FROM corpus)
      SELECT source, count(*) AS entries, sha256('[' || string_agg(entry, ',' ORDER BY place) || ']') AS root_hash FROM e GROUP BY 1""",
    "event_props_issues": """WITH p AS (SELECT event_id, (props->>'k')::BIGINT AS k FROM events)
      SELECT event_id, '$.source: required property is missing' AS issue FROM p
      UNION ALL SELECT event_id, '$.k: value is not in enum' FROM p WHERE NOT (k < 60 OR k IN (95, 99))
      UNION ALL SELECT event_id, '$.k: value is below minimum 10' FROM p WHERE k < 10 UNION ALL SELECT event_id, '$.k: value is above maximum 89' FROM p WHERE k > 89""",
    "record_schema_issues": """WITH d AS (SELECT doc_id, lang, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), l AS (SELECT doc_id, unnest(range(len(lines))) AS i, unnest(lines) AS line FROM d)
      SELECT doc_id, '$.n_chars: additional property is not allowed' AS issue FROM d UNION ALL SELECT doc_id, '$.lang: value is not in enum' FROM d WHERE lang NOT IN ('en', 'de', 'fr')
      UNION ALL SELECT doc_id, '$.source: expected string, got null' FROM d WHERE source IS NULL
      UNION ALL SELECT doc_id, '$.lines[' || i || '].n: value is above maximum 120' FROM l WHERE length(line) > 120""",
    "rich_metadata": r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, length(coalesce(text, '')) AS n,
        trim(regexp_replace(substring(split_part(coalesce(text, ''), chr(10), 1), 1, 40), '[<>&"''\\\x00-\x1f]', '', 'g'), ' ') AS line FROM documents)
      SELECT doc_id, CASE WHEN n > 900 THEN trim('LD ' || line, ' ') WHEN line = '' THEN 'document ' || doc_id ELSE line END AS title, trim('about & ' || line, ' ') AS description,
        CASE WHEN n > 900 THEN nullif(source, '') END AS author, lang || ',' || source AS tags, CASE WHEN n > 900 THEN lang || ',page' END AS keywords FROM d""",
}
