"""Contracts and gates of the documents' sources as packs, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataloom.functions import text as T
from strataloom.operators import contracts as X
from strataloom.operators import grading as G
from strataloom.operators.corpus import corpus
from strataloom.plans.tables import SQL_CORPUS, table


def _pack_records(spark, sf_dir):
    """Documents as records: routes, rights and times are missing where texts are short, of another language or toxic."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = corpus(table(spark, sf_dir, "documents")).join(labels, "doc_id", "left")
    n = F.length("content")
    return rows.select(
        "doc_id", F.col("source").alias("pack"), "document_id", "url", "title", "content", "content_hash", F.when(n > 200, "2024-01-01T00:00:00Z").alias("fetched_at"), F.lit("page").alias("content_type"), F.lit("text/markdown").alias("mime_type"),
        F.when(n % 50 == 0, 2).otherwise(3).alias("schema_version"), T.chunk_tokens(F.col("content")).alias("token_count"), F.struct(F.when(F.col("lang") != "en", "http").alias("name")).alias("route"),
        F.struct(F.when(F.coalesce("toxic", F.lit(0)) == 0, "unknown").alias("status")).alias("rights"), F.when(n > 4000, 0).alias("chunk_index"), F.when(n <= 9000, "chunk").alias("chunk_id"),
    )


def _packs(spark, sf_dir):
    """What each pack's own files say, from counts of its records."""
    rows = _pack_records(spark, sf_dir)
    n = F.count("*")
    files = F.concat(F.array(*map(F.lit, X.ARTIFACTS["raw"])), F.when(n % 2 == 0, F.array(*map(F.lit, X.ARTIFACTS["agent"]))).otherwise(F.array(F.lit("pack.score.json"))))
    filled = F.round(F.avg((F.trim("content") != "").cast("double")), 6)
    by = rows.groupBy("pack").agg(
        files.alias("artifacts"), F.lit(3).alias("schema_version"), (n - F.when(n % 3 == 0, 1).otherwise(0)).alias("record_count"), (n > 5).alias("has_record_citations"), F.lit(True).alias("has_allowed_use"), F.when(n % 4 == 0, "").otherwise("high").alias("coverage_confidence"),
        n.alias("n"), filled.alias("filled"), F.round(F.avg((F.length("content") > 200).cast("double")), 6).alias("timed"), F.sum(F.length("content")).alias("chars"),
    )
    return by


def contract_violations(spark, sf_dir):
    issues = X.contract_issues(_pack_records(spark, sf_dir), _packs(spark, sf_dir), "pack", ["doc_id"], "agent")
    return issues.select("pack", "place", "code", "field", "severity")


def contract_states(spark, sf_dir):
    packs = _packs(spark, sf_dir)
    return X.contract_status(X.contract_issues(_pack_records(spark, sf_dir), packs, "pack", ["doc_id"], "agent"), packs, "pack")


def _gate_inputs(spark, sf_dir):
    p = _packs(spark, sf_dir)
    return p.select(
        "pack", F.col("n").alias("record_count"), F.col("record_count").alias("score_records"), F.when(F.col("n") % 2 == 0, F.col("n")).alias("audit_records"), F.floor(100 * F.col("filled")).cast("int").alias("pack_score"), F.floor(100 * F.col("timed")).cast("int").alias("audit_score"),
        F.when(F.col("timed") > 0.8, "high").when(F.col("timed") > 0.5, "medium").when(F.col("timed") > 0.2, "low").alias("coverage_confidence"), F.col("filled").alias("citation_coverage"), F.when(F.col("n") > 3, (F.col("chars") % 90).cast("double")).alias("oldest_age_days"), (F.col("n") % 2 == 0).alias("eval_artifacts"),
        F.when(F.col("n") % 3 == 0, "allowed").alias("eval_generation"), F.when(F.col("n") % 5 == 0, "denied").alias("redistribution"), F.lit(None).cast("string").alias("model_training"), F.when(F.col("n") > 2, F.col("timed")).alias("supported_ratio"), F.lit(0).alias("basis_issues"), F.lit(None).cast("double").alias("pass_rate"),
    )


ASKED = X.Thresholds(max_age_days=60, require_rights=["eval_generation", "redistribution"])


def context_gates(spark, sf_dir):
    return X.gate_rows(_gate_inputs(spark, sf_dir), "pack", ASKED)


def context_gate_report(spark, sf_dir):
    return X.gate_report(context_gates(spark, sf_dir), "pack")


#: Tasks of each pack.
TASKS = 40


def _eval_tasks(spark, sf_dir):
    rows = corpus(table(spark, sf_dir, "documents")).withColumn("pack", F.coalesce("source", F.lit("")))
    # only a pack's first records make tasks, and tasks of all kinds each: the others go before anything is shuffled
    first = Window.partitionBy("pack").orderBy("doc_id")
    numbered = rows.select("pack", "doc_id", "url", "title", "content", "content_hash", F.row_number().over(first).alias("place")).where(F.col("place") <= -(-TASKS // len(G.KINDS)))
    cited = rows.where("length(content) > 300").groupBy("content_hash").agg(F.concat(F.lit("S"), F.min("doc_id")).alias("citation_id"))
    return G.eval_tasks(numbered, cited, "pack", limit=TASKS)


def eval_tasks(spark, sf_dir):
    """The first forty tasks of each source: a feature of the pack's size."""
    rows = _eval_tasks(spark, sf_dir)
    return rows.select("id", "pack", "task_type", "input", F.size("required_behavior").alias("behaviours"), "source_url", "citation_id", F.size("fail_if_contains").alias("fail_terms"), "trap")


def _predictions(spark, sf_dir):
    """Answers to tasks by what they ask for: some cite, some name the source, some hold what none may, some are blank or missing."""
    n = F.length("claim")
    answer = F.when(n % 7 == 0, " ").when(n % 5 == 0, F.concat(F.lit("UNCITED answer, see "), "source_url")).when(n % 3 == 0, F.concat(F.lit("as "), F.coalesce("citation_id", F.lit("nothing")), F.lit(" says"))).when(n % 2 == 0, F.concat(F.lit("see "), "source_url")).otherwise("no source")
    return _eval_tasks(spark, sf_dir).where(F.col("task_type") != "coverage-aware").select("id", answer.alias("answer"), F.lit(1).alias("seq"))


def graded_predictions(spark, sf_dir):
    rows = G.graded(_eval_tasks(spark, sf_dir), _predictions(spark, sf_dir))
    return rows.select("id", "status", "non_empty", "has_url", "has_citation", F.array_join("failed_terms", ";").alias("failed_terms"), "passed")


def grading_rates(spark, sf_dir):
    return G.grading_summary(G.graded(_eval_tasks(spark, sf_dir), _predictions(spark, sf_dir)), "pack")


QUERIES = [eval_tasks, graded_predictions, grading_rates, contract_violations, contract_states, context_gates, context_gate_report]

_RECORDS = f"""WITH {SQL_CORPUS}, l AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1),
  r AS (SELECT corpus.doc_id, source AS pack, url, title, content, lang, length(content) AS n, coalesce(toxic, 0) AS toxic, row_number() OVER (PARTITION BY source ORDER BY corpus.doc_id) AS place FROM corpus LEFT JOIN l ON l.doc_id = corpus.doc_id),
  p AS (SELECT pack, count(*) AS n, round(avg((trim(content, ' ') <> '')::INT), 6) AS filled, round(avg((n > 200)::INT), 6) AS timed, sum(n)::BIGINT AS chars FROM r GROUP BY 1)"""
_ISSUES = f"""{_RECORDS}, i AS (
  SELECT pack, place, 'missing_record_field' AS code, 'title' AS field, 'issue' AS severity FROM r WHERE trim(title, ' ') = ''
  UNION ALL SELECT pack, place, 'missing_record_field', 'fetched_at', 'issue' FROM r WHERE n <= 200
  UNION ALL SELECT pack, place, 'record_schema_version', NULL, 'issue' FROM r WHERE n % 50 = 0
  UNION ALL SELECT pack, place, 'missing_route_metadata', NULL, 'issue' FROM r WHERE coalesce(lang, 'en') = 'en'
  UNION ALL SELECT pack, place, 'missing_rights_state', NULL, 'issue' FROM r WHERE toxic <> 0
  UNION ALL SELECT pack, place, 'missing_chunk_id', NULL, 'issue' FROM r WHERE n > 9000
  UNION ALL SELECT pack, place, 'empty_content', NULL, 'warning' FROM r WHERE trim(content, ' ') = ''
  UNION ALL SELECT pack, NULL, 'missing_artifact', unnest(['context.lock.json', 'coverage.report.json', 'citation.index.json', 'pack.audit.json']), 'issue' FROM p WHERE n % 2 <> 0
  UNION ALL SELECT pack, NULL, 'record_count_mismatch', NULL, 'issue' FROM p WHERE n % 3 = 0
  UNION ALL SELECT pack, NULL, 'missing_record_citations', NULL, 'issue' FROM p WHERE n <= 5
  UNION ALL SELECT pack, NULL, 'coverage_confidence_unknown', NULL, 'warning' FROM p WHERE n % 4 = 0)"""
_GATES = f"""{_RECORDS}, g AS (
  SELECT pack, 'pack_score_current' AS gate, CASE WHEN n % 3 <> 0 THEN 'pass' ELSE 'fail' END AS status, NULL AS value, NULL AS threshold FROM p
  UNION ALL SELECT pack, 'pack_audit_current', CASE WHEN n % 2 = 0 THEN 'pass' ELSE 'fail' END, NULL, NULL FROM p
  UNION ALL SELECT pack, 'pack_score', CASE WHEN floor(100 * filled) >= 80 THEN 'pass' ELSE 'fail' END, floor(100 * filled)::INT::VARCHAR, '80' FROM p
  UNION ALL SELECT pack, 'audit_score', CASE WHEN floor(100 * timed) >= 80 THEN 'pass' ELSE 'fail' END, floor(100 * timed)::INT::VARCHAR, '80' FROM p
  UNION ALL SELECT pack, 'coverage_confidence', CASE WHEN timed > 0.8 THEN 'pass' WHEN timed > 0.5 THEN 'warn' WHEN timed > 0.2 THEN 'fail' ELSE 'warn' END, CASE WHEN timed > 0.8 THEN 'high' WHEN timed > 0.5 THEN 'medium' WHEN timed > 0.2 THEN 'low' ELSE 'unknown' END, NULL FROM p
  UNION ALL SELECT pack, 'citation_coverage', CASE WHEN filled >= 0.9 THEN 'pass' ELSE 'fail' END, filled::DOUBLE::VARCHAR, '0.9' FROM p
  UNION ALL SELECT pack, 'max_age_days', CASE WHEN n <= 3 THEN 'warn' WHEN chars % 90 <= 60 THEN 'pass' ELSE 'fail' END, CASE WHEN n > 3 THEN (chars % 90)::DOUBLE::VARCHAR END, '60' FROM p
  UNION ALL SELECT pack, 'eval_grade_artifacts', CASE WHEN n % 2 = 0 THEN 'pass' ELSE 'warn' END, NULL, NULL FROM p
  UNION ALL SELECT pack, 'rights_eval_generation', CASE WHEN n % 3 = 0 THEN 'pass' ELSE 'fail' END, CASE WHEN n % 3 = 0 THEN 'allowed' ELSE 'unknown' END, 'allowed_or_allowed_with_conditions' FROM p
  UNION ALL SELECT pack, 'rights_redistribution', 'fail', CASE WHEN n % 5 = 0 THEN 'denied' ELSE 'unknown' END, 'allowed_or_allowed_with_conditions' FROM p
  UNION ALL SELECT pack, 'basis_quality', CASE WHEN n > 2 AND timed >= 0.8 THEN 'pass' ELSE 'warn' END, CASE WHEN n > 2 THEN timed::DOUBLE::VARCHAR END, '0.8' FROM p
  UNION ALL SELECT pack, 'context_prediction_pass_rate', 'skip', NULL, NULL FROM p)"""

_TASKS = rf"""WITH {SQL_CORPUS}, c AS (SELECT content_hash, 'S' || min(doc_id) AS citation_id FROM corpus WHERE length(content) > 300 GROUP BY 1),
  r AS (SELECT coalesce(source, '') AS pack, doc_id, url, coalesce(nullif(title, ''), url) AS title, content, content_hash, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id) AS place FROM corpus),
  k AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{k}', '{v[0]}', '{v[1]}', {3 + bool(v[2])})" for i, (k, v) in enumerate(G.KINDS.items()))}) AS t(turn, task_type, before, after, behaviours)),
  b AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(content, '(?m)^\s{{0,3}}#{{1,6}}\s*', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '\s+', ' ', 'g'), ' ') AS bare FROM r WHERE trim(content, ' ') <> ''),
  s AS (SELECT *, regexp_matches(content, '{G.DEPRECATION}') AS stale, list_filter(string_split(regexp_replace(bare, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda x: length(trim(x, ' ')) >= 40) AS long FROM b),
  t AS (SELECT 'eval_' || left(sha256(pack || chr(31) || task_type || chr(31) || url || chr(31) || s.content_hash), 24) AS id, pack, task_type, before || title || after AS input, behaviours, url AS source_url, citation_id,
    CASE WHEN stale OR task_type = 'version-drift' THEN 5 ELSE 2 END AS fail_terms, stale OR task_type = 'version-drift' AS trap, CASE WHEN len(long) > 0 THEN trim(long[1], ' ') ELSE bare END AS said
    FROM s CROSS JOIN k LEFT JOIN c ON c.content_hash = s.content_hash WHERE (place - 1) * 4 + turn < 40),
  n AS (SELECT *, CASE WHEN length(said) <= 420 THEN length(said) ELSE length(rtrim(left(said, 417), ' ')) + 3 END AS n FROM t),
  g AS (SELECT *, task_type <> 'coverage-aware' AS told, n % 7 = 0 AS blank, n % 7 <> 0 AND n % 5 = 0 AS bad, n % 7 <> 0 AND n % 5 <> 0 AND n % 3 = 0 AS cites, n % 7 <> 0 AND n % 5 <> 0 AND n % 3 <> 0 AND n % 2 = 0 AS sees FROM n),
  q AS (SELECT *, told AND NOT blank AS non_empty, told AND (bad OR sees) AS has_url, told AND cites AND citation_id IS NOT NULL AS has_citation FROM g)"""

SQL = {
    "eval_tasks": f"{_TASKS} SELECT id, pack, task_type, input, behaviours, source_url, citation_id, fail_terms, trap FROM t",
    "graded_predictions": f"""{_TASKS} SELECT id, CASE WHEN told THEN 'graded' ELSE 'missing_prediction' END AS status, non_empty, has_url, has_citation OR (told AND (bad OR sees) AND citation_id IS NOT NULL AND contains(source_url, citation_id)) AS has_citation, CASE WHEN told AND bad THEN 'uncited answer' ELSE '' END AS failed_terms,
      non_empty AND (has_url OR has_citation) AND NOT bad AS passed FROM q""",
    "grading_rates": f"{_TASKS} SELECT pack, count(*) AS tasks, count(*) FILTER (told) AS graded, count(*) FILTER (non_empty AND (has_url OR has_citation) AND NOT bad) AS passed, CASE WHEN count(*) FILTER (told) > 0 THEN round(count(*) FILTER (non_empty AND (has_url OR has_citation) AND NOT bad) / count(*) FILTER (told), 6) END AS pass_rate FROM q GROUP BY 1",
    "contract_violations": f"{_ISSUES} SELECT * FROM i",
    "contract_states": f"""{_ISSUES} SELECT p.pack, CASE WHEN count(*) FILTER (severity = 'issue') = 0 THEN 'pass' ELSE 'fail' END AS status, count(*) FILTER (severity = 'issue') AS issue_count,
      count(*) FILTER (severity = 'warning') AS warning_count, count(*) FILTER (code = 'missing_artifact') AS missing_artifacts FROM p LEFT JOIN i ON i.pack IS NOT DISTINCT FROM p.pack GROUP BY 1""",
    "context_gates": f"{_GATES} SELECT * FROM g",
    "context_gate_report": f"""{_GATES} SELECT pack, bool_and(status <> 'fail') AS passed, count(*) AS gate_count, count(*) FILTER (status = 'pass') AS pass_count, count(*) FILTER (status = 'warn') AS warn_count,
      count(*) FILTER (status = 'fail') AS fail_count, count(*) FILTER (status = 'skip') AS skip_count FROM g GROUP BY 1""",
}
