"""Queries on runs, frontiers, labels and vectors, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import evaluation as E
from strataloom.operators import freshness as A
from strataloom.operators import frontier as R
from strataloom.operators import graph as G
from strataloom.operators import search as Q
from strataloom.operators import statistics as S
from strataloom.plans.analytics import _trials
from strataloom.plans.tables import table


def mcnemar_holm(spark, sf_dir):
    """Exact probabilities of all pairs of systems and their step-down adjustment."""
    tests = S.holm(S.paired(_trials(spark, sf_dir), "case", "system", "ok"), ties=("a", "b"))
    return tests.select("a", "b", "a_only", "b_only", F.round("p_value", 9).alias("p_value"), F.round("p_adjusted", 9).alias("p_adjusted"))


def label_agreement(spark, sf_dir):
    """Agreement and kappa of the labels with a rule on the text's length."""
    rule = F.length(F.coalesce("text", F.lit(""))) >= 400
    docs = table(spark, sf_dir, "documents").select("doc_id", rule.alias("ruled"))
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("marked"))
    return E.agreement(labels.join(docs, "doc_id"), "marked", "ruled")


def run_stats(spark, sf_dir):
    """Trials of each system: passes of all and any trials of a case, median, 95th place, interval."""
    return E.system_stats(E.trials(table(spark, sf_dir, "events")))


def vector_topk(spark, sf_dir):
    """The ten vectors nearest to the one with number 7; those under 0.2 go after the cut."""
    vectors = table(spark, sf_dir, "embeddings")
    query = vectors.where("vec_id = 7").select("embedding").first()
    return Q.vector_search(vectors, list(query["embedding"]) if query else [], 10, 0.2)


def reachable_parts(spark, sf_dir):
    """What is within two steps of supplier 1: its parts, as numbers below 0, and who else supplies them."""
    supplied = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    links = supplied.select(F.col("l_suppkey").alias("from_id"), (-1 - F.col("l_partkey")).alias("to_id"))
    back = links.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    return G.closure(links.unionByName(back), spark.createDataFrame([(1,)], "node long"), 2)


def _log(spark, sf_dir):
    """Events as a frontier log: users are urls, event types are states."""
    kinds = F.create_map(*[F.lit(x) for pair in (("click", "processing"), ("view", "queued"), ("purchase", "saved"), ("signup", "skipped")) for x in pair])
    state = F.coalesce(kinds[F.col("event_type")], F.lit("failed"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", state.alias("state"))


def frontier_latest(spark, sf_dir):
    return R.latest_states(_log(spark, sf_dir), "user_id", "event_id", "state")


SECOND_RUN = "1998-06-01"


def frontier_pending(spark, sf_dir):
    """Pairs of part and supplier that were shipped in the first run and not yet in the second."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate")
    late = F.col("l_shipdate") >= F.lit(SECOND_RUN).cast("timestamp")
    return R.pending(items.where(~late).select("l_partkey", "l_suppkey").distinct(), items.where(late), ["l_partkey", "l_suppkey"])


def progress_counters(spark, sf_dir):
    return R.progress(_log(spark, sf_dir), "user_id", "event_id", "state")


def regression_classes(spark, sf_dir):
    """Pairs of part and supplier as cases of two runs: unsupported if all was returned, passed if no discount was over 8 %."""
    items = table(spark, sf_dir, "lineitem").withColumn("late", F.col("l_shipdate") >= F.lit(SECOND_RUN).cast("timestamp"))
    run = F.struct(F.bool_or(F.col("l_returnflag") != "R").alias("supported"), F.bool_and(F.col("l_discount") <= 0.08).alias("passed"))
    cases = items.groupBy("l_partkey", "l_suppkey", "late").agg(run.alias("run")).groupBy("l_partkey", "l_suppkey").pivot("late", [False, True]).agg(F.first("run"))
    return cases.select("l_partkey", "l_suppkey", R.regression_class(F.col("false"), F.col("true")).alias("change"))


def best_runs(spark, sf_dir):
    """Each user's event of largest value, the first of several."""
    return R.best_per_target(table(spark, sf_dir, "events"), "user_id", "value", "event_id")


def library_counts(spark, sf_dir):
    """Documents of each source, in the order of the sources."""
    return table(spark, sf_dir, "documents").groupBy(F.coalesce("source", F.lit("")).alias("library")).agg(F.count("*").alias("chunks")).orderBy("library")


def document_page(spark, sf_dir):
    """The second page of twenty documents, in the order of their keys."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang").orderBy("doc_id").offset(20).limit(20)


def substring_grep(spark, sf_dir):
    """Documents with a substring in any case; per cent signs and underscores stand for themselves."""
    docs = table(spark, sf_dir, "documents")
    return docs.where(F.contains(F.lower("text"), F.lit("the "))).select("doc_id", "source", F.length("text").cast("long").alias("n"))


def title_query_list(spark, sf_dir):
    """Distinct first lines of pages' documents as queries: trimmed, folded, the first spelling kept."""
    line = F.trim(F.substring_index("text", "\n", 1))
    rows = table(spark, sf_dir, "documents").select("doc_id", line.alias("query")).where("query <> ''")
    return rows.groupBy(F.lower("query").alias("folded")).agg(F.min(F.struct("doc_id", "query")).alias("first")).select(F.col("first.doc_id").alias("doc_id"), F.col("first.query").alias("query"))


AS_OF, MAX_AGE_DAYS = "2024-03-01 00:00:00", 45.0


def _entries(spark, sf_dir):
    """Events as a manifest: ids are documents, users urls.  Only purchases hold a time of their own, and
    no record of an error has one, so that errors take the time of their user's first other event."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("document_id"), F.col("user_id").alias("url"), "event_type", "ts")
    manifest = events.select("document_id", "url", F.when(F.col("event_type") == "purchase", F.col("ts")).alias("fetched_at"))
    records = events.select("document_id", "url", F.when(F.col("event_type") != "error", F.col("ts")).alias("fetched_at"))
    return A.with_fallback_times(manifest, records.withColumn("seq", F.col("document_id")), "seq")


def stale_sources(spark, sf_dir):
    return A.stale(_entries(spark, sf_dir), F.lit(AS_OF).cast("timestamp"), MAX_AGE_DAYS).select("document_id", "url", "age_days")


def staleness_report(spark, sf_dir):
    return A.staleness(_entries(spark, sf_dir), F.lit(AS_OF).cast("timestamp"), MAX_AGE_DAYS)


QUERIES = [mcnemar_holm, label_agreement, run_stats, vector_topk, reachable_parts, frontier_latest, frontier_pending, progress_counters, regression_classes, best_runs, library_counts, document_page, substring_grep, title_query_list, stale_sources, staleness_report]

_TRIALS = "WITH trials AS (SELECT l_orderkey AS cs, l_returnflag || l_linestatus AS system, (l_discount <= 0.08)::INT AS ok FROM lineitem)"
_LOG = "WITH log AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'processing' WHEN 'view' THEN 'queued' WHEN 'purchase' THEN 'saved' WHEN 'signup' THEN 'skipped' ELSE 'failed' END AS state FROM events)"
_EVENTS = "WITH t AS (SELECT event_type AS system, user_id AS case_id, event_id, value, value >= 50 AS passed FROM events)"
_Z = repr(S.Z95)

_AGES = f"""WITH known AS (SELECT user_id, arg_min(ts, event_id) AS first_ts FROM events WHERE event_type <> 'error' GROUP BY 1),
      e AS (SELECT event_id AS document_id, e.user_id AS url, CASE WHEN event_type <> 'error' THEN ts ELSE first_ts END AS ts FROM events e LEFT JOIN known k ON e.user_id = k.user_id),
      a AS (SELECT *, date_diff('microsecond', ts, TIMESTAMP '{AS_OF}') / 86400000000.0 AS age FROM e)"""

SQL = {
    "mcnemar_holm": f"""{_TRIALS}, o AS (SELECT cs, system, min(ok) AS ok FROM trials GROUP BY 1, 2),
      c AS (SELECT x.system AS a, y.system AS b, sum(x.ok * (1 - y.ok))::BIGINT AS a_only, sum((1 - x.ok) * y.ok)::BIGINT AS b_only FROM o x JOIN o y ON x.cs = y.cs AND x.system < y.system GROUP BY 1, 2),
      p AS (SELECT *, CASE WHEN a_only + b_only = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(a_only, b_only) + 1),
        lambda i: exp(lgamma(a_only + b_only + 1.0) - lgamma(i + 1.0) - lgamma(a_only + b_only - i + 1.0) - (a_only + b_only) * ln(2))))) END AS p FROM c),
      s AS (SELECT *, least(1, p * (count(*) OVER () - row_number() OVER (ORDER BY p, a, b) + 1)) AS step FROM p)
      SELECT a, b, a_only, b_only, round(p, 9) AS p_value, round(max(step) OVER (ORDER BY p, a, b ROWS UNBOUNDED PRECEDING), 9) AS p_adjusted FROM s""",
    "label_agreement": """WITH j AS (SELECT (quality = 1)::INT::DOUBLE AS a, (length(coalesce(text, '')) >= 400)::INT::DOUBLE AS b FROM labels JOIN documents USING (doc_id)),
      o AS (SELECT count(*) AS n, avg((a = b)::INT) AS po, avg(a) AS pa, avg(b) AS pb FROM j), e AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM o)
      SELECT n, round(po, 6) AS agreement, round(CASE WHEN pe >= 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM e""",
    "run_stats": f"""{_EVENTS}, c AS (SELECT system, case_id, min(passed) AS a, max(passed) AS o FROM t GROUP BY 1, 2),
      cs AS (SELECT system, count(*) AS cases, avg(a::INT) AS all_rate, avg(o::INT) AS any_rate, avg((a = o)::INT) AS stability FROM c GROUP BY 1),
      r AS (SELECT system, count(*) AS trials, sum(passed::INT)::BIGINT AS passed, quantile_cont(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM t GROUP BY 1),
      w AS (SELECT *, passed / trials AS p, {_Z} AS z FROM r)
      SELECT system, cases, trials, passed, round(all_rate, 6) AS all_rate, round(any_rate, 6) AS any_rate, round(stability, 6) AS stability, round(p50, 6) AS p50, round(p95, 6) AS p95,
        round(greatest(0, (p + z * z / (2 * trials) - z * sqrt((p * (1 - p) + z * z / (4 * trials)) / trials)) / (1 + z * z / trials)), 6) AS low,
        round(least(1, (p + z * z / (2 * trials) + z * sqrt((p * (1 - p) + z * z / (4 * trials)) / trials)) / (1 + z * z / trials)), 6) AS high FROM w JOIN cs USING (system)""",
    "vector_topk": """WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 7),
      s AS (SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], e), 6) AS similarity FROM embeddings, q),
      r AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 10 AND similarity >= 0.2""",
    "reachable_parts": """WITH l AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), one AS (SELECT DISTINCT p FROM l WHERE s = 1), two AS (SELECT DISTINCT s FROM l JOIN one USING (p) WHERE s <> 1)
      SELECT 1::BIGINT AS node, 0 AS depth UNION ALL SELECT -1 - p, 1 FROM one UNION ALL SELECT s, 2 FROM two""",
    "frontier_latest": f"{_LOG} SELECT user_id, arg_max(state, event_id) AS state, count(*) FILTER (state = 'processing') AS attempts FROM log GROUP BY 1",
    "frontier_pending": f"""SELECT l_partkey, l_suppkey FROM lineitem WHERE l_shipdate < '{SECOND_RUN}'
      EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_shipdate >= '{SECOND_RUN}'""",
    "progress_counters": f"""{_LOG}, c AS (SELECT user_id, event_id, count(*) FILTER (state = 'saved') OVER w AS saved, count(*) FILTER (state = 'skipped') OVER w AS skipped, count(*) FILTER (state = 'failed') OVER w AS failed
      FROM log WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) SELECT *, saved + skipped + failed AS processed FROM c""",
    "regression_classes": f"""WITH c AS (SELECT l_partkey, l_suppkey, count(*) FILTER (NOT late) > 0 AS old, count(*) FILTER (late) > 0 AS new,
        count(*) FILTER (NOT late AND l_returnflag <> 'R') > 0 AS b_ok, count(*) FILTER (late AND l_returnflag <> 'R') > 0 AS a_ok,
        count(*) FILTER (NOT late AND l_discount > 0.08) = 0 AS b, count(*) FILTER (late AND l_discount > 0.08) = 0 AS a FROM (SELECT *, l_shipdate >= '{SECOND_RUN}' AS late FROM lineitem) GROUP BY 1, 2)
      SELECT l_partkey, l_suppkey, CASE WHEN NOT new THEN 'regression' WHEN NOT a_ok THEN 'unsupported' WHEN NOT old THEN CASE WHEN a THEN 'improvement' ELSE 'persistent_gap' END
        WHEN NOT b_ok THEN 'improvement' WHEN b AND NOT a THEN 'regression' WHEN NOT b AND a THEN 'improvement' WHEN NOT a THEN 'persistent_gap' ELSE 'unchanged' END AS change FROM c""",
    "best_runs": "SELECT user_id, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events WHERE value IS NOT NULL) WHERE r = 1",
    "library_counts": "SELECT coalesce(source, '') AS library, count(*) AS chunks FROM documents GROUP BY 1",
    "document_page": "SELECT doc_id, source, lang FROM documents ORDER BY doc_id LIMIT 20 OFFSET 20",
    "substring_grep": "SELECT doc_id, source, length(text) AS n FROM documents WHERE contains(lower(text), 'the ')",
    "title_query_list": """WITH q AS (SELECT doc_id, trim(string_split(text, chr(10))[1], ' ') AS query FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lower(query) ORDER BY doc_id) AS r FROM q WHERE query <> '')
      SELECT doc_id, query FROM r WHERE r = 1""",
    "stale_sources": f"{_AGES} SELECT document_id, url, round(age, 2) AS age_days FROM a WHERE age > {MAX_AGE_DAYS}",
    "staleness_report": f"{_AGES} SELECT count(*) AS entries, count(*) FILTER (age > {MAX_AGE_DAYS}) AS stale_count, count(*) FILTER (age IS NULL) AS unknown_age_count, round(max(age), 2) AS oldest_days, round(min(age), 2) AS freshest_days FROM a",
}
