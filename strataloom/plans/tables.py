"""Reading the tables and the SQL text that several oracles share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataloom.functions import urls as U


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, {quoted(U.SCHEME)}, 1))"


def sql_netloc(u: str) -> str:
    return f"lower(regexp_extract({u}, {quoted(U.NETLOC)}, 1))"


def sql_host(u: str) -> str:
    return f"regexp_extract({sql_netloc(u)}, {quoted(U.HOST)}, 1)"


def sql_path(u: str) -> str:
    return f"regexp_extract({u}, {quoted(U.PATH)}, 1)"


def sql_query(u: str) -> str:
    return f"regexp_extract({u}, {quoted(U.QUERY)}, 1)"


def sql_segments(u: str) -> str:
    return f"list_filter(string_split(lower({sql_path(u)}), '/'), lambda s: s <> '')"


def sql_built(u: str, path: str) -> str:
    return (
        f"{sql_scheme(u)} || '://' || {sql_netloc(u)} || (CASE WHEN rtrim({path}, '/') = '' THEN '/' ELSE rtrim({path}, '/') END)"
        f" || (CASE WHEN {sql_query(u)} <> '' THEN '?' || {sql_query(u)} ELSE '' END)"
    )


def sql_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def sql_any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


def sql_domain(host: str, domain: str) -> str:
    return f"({host} = {quoted(domain)} OR ends_with({host}, {quoted('.' + domain)}))"


#: The corpus that ``operators.corpus.corpus`` makes of the documents.
SQL_CORPUS = """corpus AS (
  SELECT doc_id, source, lang, 'https://' || source || '.example/docs/' || doc_id AS url,
    trim(left(split_part(coalesce(text, ''), chr(10), 1), 60)) AS title, coalesce(text, '') AS content, sha256(coalesce(text, '')) AS content_hash
  FROM documents
)"""
SQL_SNAPSHOTS = (
    "WITH "
    + SQL_CORPUS
    + """, old AS (SELECT url, title, content, content_hash FROM corpus), kept AS (
  SELECT d.doc_id, d.source, CASE WHEN toxic = 1 THEN d.text || chr(10) || 'This page is deprecated; see the security notice and the new pricing plan.' ELSE d.text END AS text
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE quality IS NULL OR quality <> 0
), new AS (
  SELECT 'https://' || source || '.example/docs/' || doc_id AS url, trim(left(split_part(coalesce(text, ''), chr(10), 1), 60)) AS title,
    coalesce(text, '') AS content, sha256(coalesce(text, '')) AS content_hash FROM kept
  UNION ALL SELECT 'https://benchmark.example/items/' || item_id, 'Item ' || item_id, coalesce(text, ''), sha256(coalesce(text, '')) FROM benchmark
), pairs AS (
  SELECT coalesce(o.url, n.url) AS url, coalesce(o.content, '') AS before, coalesce(n.content, '') AS after, o.content_hash IS NULL AS added, n.content_hash IS NULL AS removed
  FROM old o FULL OUTER JOIN new n ON o.url = n.url WHERE o.content_hash IS DISTINCT FROM n.content_hash
)"""
)
