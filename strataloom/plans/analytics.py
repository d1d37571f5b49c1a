"""Queries on statistics, profiles, windows and relational tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.operators import statistics as S
from strataloom.operators import tables as T
from strataloom.plans.tables import table


def _trials(spark, sf_dir):
    """Line items as trials: a pair of flags is a system, an order a case, a low discount a pass."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case"), F.concat("l_returnflag", "l_linestatus").alias("system"), (F.col("l_discount") <= 0.08).alias("ok"), F.col("l_discount").cast("double").alias("score"))


def wilson_intervals(spark, sf_dir):
    rates = _trials(spark, sf_dir).groupBy("system").agg(F.count("*").alias("trials"), F.sum(F.col("ok").cast("long")).alias("passed"))
    low, high = S.wilson(F.col("passed"), F.col("trials"))
    return rates.select("system", "trials", "passed", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


def paired_systems(spark, sf_dir):
    found = S.paired(_trials(spark, sf_dir), "case", "system", "ok")
    return found.select("a", "b", "cases", "both", "a_only", "b_only")


def pass_all_trials(spark, sf_dir):
    found = S.pass_all(_trials(spark, sf_dir), "case", "system", "score", 0.02)
    return found.withColumn("pass_rate", F.round("pass_rate", 9))


def nearest_rank_percentiles(spark, sf_dir):
    lengths = table(spark, sf_dir, "documents").select("lang", F.length("text").alias("n"))
    return S.nearest_ranks(lengths, ["lang"], "n", {"p50": 0.5, "p95": 0.95})


def column_profiles(spark, sf_dir):
    return T.column_profile(table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_mktsegment", "c_nationkey"]).drop("type")


def ranked_values(spark, sf_dir):
    return T.ranked_values(table(spark, sf_dir, "documents"), "source", 5, ["lang"])


def latest_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return T.top_per_group(orders, ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"], 3)


QUERIES = [wilson_intervals, paired_systems, pass_all_trials, nearest_rank_percentiles, column_profiles, ranked_values, latest_orders]

_Z = repr(S.Z95)
_TRIALS = "WITH trials AS (SELECT l_orderkey AS cs, l_returnflag || l_linestatus AS system, (l_discount <= 0.08)::INT AS ok, l_discount::DOUBLE AS score FROM lineitem)"
_PROFILE = lambda c: (
    f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null, count(*) FILTER (trim({c}::VARCHAR) = '') AS n_blank, min({c}::VARCHAR) AS least, max({c}::VARCHAR) AS largest FROM customer"
)
_NEAREST = lambda q: f"list_sort(list(length(text)) FILTER (text IS NOT NULL))[greatest(ceil({q} * count(text)), 1)::BIGINT]"

SQL = {
    "wilson_intervals": f"""{_TRIALS}, r AS (SELECT system, count(*) AS trials, sum(ok)::BIGINT AS passed FROM trials GROUP BY system), p AS (SELECT *, passed / trials AS p, {_Z} AS z FROM r)
      SELECT system, trials, passed, round(greatest(0, (p + z * z / (2 * trials) - z * sqrt(p * (1 - p) / trials + z * z / (4 * trials * trials))) / (1 + z * z / trials)), 9) AS low,
        round(least(1, (p + z * z / (2 * trials) + z * sqrt(p * (1 - p) / trials + z * z / (4 * trials * trials))) / (1 + z * z / trials)), 9) AS high FROM p""",
    "paired_systems": f"""{_TRIALS}, o AS (SELECT cs, system, min(ok) AS ok FROM trials GROUP BY 1, 2)
      SELECT x.system AS a, y.system AS b, count(*) AS cases, sum(x.ok * y.ok)::BIGINT AS "both", sum(x.ok * (1 - y.ok))::BIGINT AS a_only, sum((1 - x.ok) * y.ok)::BIGINT AS b_only
      FROM o x JOIN o y ON x.cs = y.cs AND x.system < y.system GROUP BY 1, 2""",
    "pass_all_trials": f"{_TRIALS}, w AS (SELECT system, cs, min(score) >= 0.02 AS ok FROM trials GROUP BY 1, 2) SELECT system, count(*) AS cases, count(*) FILTER (ok) AS passed, round(avg(ok::INT), 9) AS pass_rate FROM w GROUP BY 1",
    "nearest_rank_percentiles": f"SELECT lang, {_NEAREST(0.5)} AS p50, {_NEAREST(0.95)} AS p95 FROM documents GROUP BY lang",
    "column_profiles": " UNION ALL ".join(map(_PROFILE, ("c_custkey", "c_name", "c_mktsegment", "c_nationkey"))),
    "ranked_values": "SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS rank, source, n FROM (SELECT lang, source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1, 2)) WHERE rank <= 5",
    "latest_orders": "SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3",
}
