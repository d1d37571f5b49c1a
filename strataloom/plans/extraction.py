"""Queries on chunks, Markdown, redaction and robots rules, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.functions import urls as U
from strataloom.operators import robots as R
from strataloom.operators.chunks import chunk_documents
from strataloom.operators.corpus import corpus
from strataloom.operators.markdown import to_markdown
from strataloom.operators.redaction import redact, sensitive_totals
from strataloom.plans.tables import quoted, sql_host, sql_list, sql_path, table

AGENT = "corpusbot"
#: The robots file of hosts by their last label; the others have none.
FILES = {
    "com": "User-agent: otherbot\nDisallow: /\n\nUser-agent: *\nAllow: /en/1\nDisallow: /en/ # the rest\nDisallow: /fr/\nCrawl-delay: 2\n\nSitemap: https://example.com/sitemap.xml",
    "net": "user-agent: *\ndisallow: /\n\nuser-agent: otherbot\nuser-agent: corpusbot\ncrawl-delay: 0.5\ndisallow: /de/\ndisallow: /es/1\nallow: /\n\ndisallow: /en/",
}
HEADERS = [("a", "noindex, nofollow"), ("b", "otherbot: noindex, noai"), ("c", "CorpusBot: noai, max-snippet:0, otherbot: none, nofollow"), ("d", "max-snippet: 0, NoIndex noarchive"), ("e", "")]


def html_markdown(spark, sf_dir):
    return to_markdown(table(spark, sf_dir, "pages")).select("page_id", F.length("content").cast("long").alias("n_chars"), T.content_hash(F.col("content")).alias("content_hash"))


def page_chunks(spark, sf_dir):
    """Chunks of pages' Markdown, cut at headings and paragraphs, with their stable ids."""
    rows = to_markdown(table(spark, sf_dir, "pages")).withColumn("content_hash", T.content_hash(F.col("content")))
    made = chunk_documents(rows, "page_id", "content", 100, keep=["url", "content_hash"])
    number = F.col("chunk_index")
    return made.select("page_id", "chunk_index", "heading", "token_count", "chunk_hash", T.stable_id("chunk", F.col("url"), F.col("content_hash"), number, F.col("heading")).alias("chunk_id"))


def document_chunks(spark, sf_dir):
    return chunk_documents(corpus(table(spark, sf_dir, "documents"))).select("doc_id", "chunk_index", "heading", "token_count", "chunk_hash")


def redacted_documents(spark, sf_dir):
    rows = redact(corpus(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", T.content_hash(F.col("redacted")).alias("redacted_hash"), F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, n: a + n).alias("matches"))


def sensitive_scan(spark, sf_dir):
    """Matches of each rule after overlaps are resolved."""
    return sensitive_totals(redact(corpus(table(spark, sf_dir, "documents"))))


def _robots(spark, sf_dir):
    label = F.regexp_extract("host", r"\.([a-z]+)$", 1)
    body = F.coalesce(*[F.when(label == k, F.lit(v)) for k, v in FILES.items()])
    hosts = table(spark, sf_dir, "pages").select(U.host(F.col("url")).alias("host")).distinct()
    return R.robots_rules(hosts.select("host", body.alias("body")).where("body is not null"), AGENT)


def robots_rules(spark, sf_dir):
    return _robots(spark, sf_dir).select("host", F.size("rules").cast("long").alias("rules"), "crawl_delay", F.array_join("sitemaps", ",").alias("sitemaps"))


def robots_access(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", U.host(F.col("url")).alias("host"), U.path(F.col("url")).alias("path"))
    return rows.join(_robots(spark, sf_dir), "host", "left").select("page_id", "path", R.allowed(F.col("rules"), F.col("path")).alias("allowed"))


def robots_header(spark, sf_dir):
    rows = spark.createDataFrame(HEADERS, "id string, value string")
    return rows.select("id", F.array_join(R.header_directives(F.col("value"), AGENT), ",").alias("directives"))


QUERIES = [html_markdown, page_chunks, document_chunks, redacted_documents, sensitive_scan, robots_rules, robots_access, robots_header]

_VALUES = lambda rows: ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in rows)
_RULES = f"""WITH files(label, body) AS (VALUES {_VALUES(FILES.items())}), hosts AS (SELECT DISTINCT {sql_host('url')} AS host FROM pages),
l AS (SELECT label, generate_subscripts(string_split(body, chr(10)), 1) AS pos, unnest(string_split(body, chr(10))) AS line FROM files),
f AS (SELECT label, pos, trim(line) = '' AS blank, lower(trim(split_part(line, ':', 1))) AS field, trim(regexp_replace(regexp_extract(line, '^[^:]*:(.*)$', 1), '#.*', '')) AS value FROM l),
p AS (SELECT *, lag(field) OVER (PARTITION BY label ORDER BY pos) AS before FROM f),
g AS (SELECT *, sum(CASE WHEN blank OR (field = 'user-agent' AND before IS DISTINCT FROM 'user-agent') THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY pos) AS part FROM p),
fit AS (SELECT label, part, bool_or(value = '*') AS for_all FROM g WHERE field = 'user-agent' AND (value = '*' OR contains({quoted(AGENT)}, lower(value))) GROUP BY ALL),
best AS (SELECT label, part FROM fit QUALIFY row_number() OVER (PARTITION BY label ORDER BY for_all, part) = 1),
r AS (SELECT g.label, pos, field = 'allow' OR value = '' AS allow, value AS path FROM g JOIN best ON g.label = best.label AND g.part = best.part WHERE field IN ('allow', 'disallow')),
d AS (SELECT g.label, max(value::DOUBLE) AS delay FROM (SELECT * FROM g WHERE field = 'crawl-delay') g JOIN best ON g.label = best.label AND g.part = best.part GROUP BY ALL)"""

SQL = {
    "robots_rules": f"{_RULES} SELECT host, (SELECT count(*) FROM r WHERE r.label = files.label) AS rules, (SELECT delay FROM d WHERE d.label = files.label) AS crawl_delay, coalesce((SELECT string_agg(value, ',' ORDER BY pos) FROM g WHERE field = 'sitemap' AND g.label = files.label), '') AS sitemaps FROM hosts JOIN files ON files.label = regexp_extract(host, '\\.([a-z]+)$', 1)",
    "robots_access": f"{_RULES}, u AS (SELECT page_id, {sql_path('url')} AS path, regexp_extract({sql_host('url')}, '\\.([a-z]+)$', 1) AS label FROM pages), m AS (SELECT page_id, arg_min(allow, pos) AS allow FROM u JOIN r ON r.label = u.label AND starts_with(u.path, r.path) GROUP BY page_id) SELECT u.page_id, path, coalesce(allow, true) AS allowed FROM u LEFT JOIN m ON m.page_id = u.page_id",
    "robots_header": f"""WITH v(id, value) AS (VALUES {_VALUES(HEADERS)}), t AS (SELECT id, generate_subscripts(string_split(value, ','), 1) AS i, trim(unnest(string_split(value, ','))) AS token FROM v),
      n AS (SELECT *, contains(token, ':') AND NOT list_contains({sql_list(R.VALUED_DIRECTIVES)}, lower(trim(split_part(token, ':', 1)))) AS names FROM t),
      s AS (SELECT *, last_value(CASE WHEN names THEN lower(trim(split_part(token, ':', 1))) END IGNORE NULLS) OVER (PARTITION BY id ORDER BY i) AS scope, CASE WHEN names THEN trim(regexp_extract(token, '^[^:]*:(.*)$', 1)) ELSE token END AS rest FROM n),
      w AS (SELECT id, unnest(regexp_split_to_array(lower(split_part(rest, ':', 1)), '\\s+')) AS word FROM s WHERE scope IS NULL OR scope = {quoted(AGENT)})
      SELECT v.id, coalesce(string_agg(DISTINCT word, ',' ORDER BY word) FILTER (word <> ''), '') AS directives FROM v LEFT JOIN w ON w.id = v.id GROUP BY v.id""",
}
