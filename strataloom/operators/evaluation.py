"""Statistics over trials, rankings and labels."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Z95 = 1.959963984540054


def wilson(passed: Column, total: Column) -> tuple[Column, Column]:
    """The 95% interval of a proportion; (0, 0) of nothing."""
    p, z2 = passed / total, F.lit(Z95**2)
    centre, spread = p + z2 / (2 * total), F.lit(Z95) * F.sqrt((p * (1 - p) + z2 / (4 * total)) / total)
    low, high = (centre - spread) / (1 + z2 / total), (centre + spread) / (1 + z2 / total)
    none = total == 0
    return F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), low)), F.when(none, 0.0).otherwise(F.least(F.lit(1.0), high))


def trials(events: DataFrame) -> DataFrame:
    """``events`` as benchmark trials: a system (event type) tries a case (user); value is its latency."""
    return events.select(F.col("event_type").alias("system"), F.col("user_id").alias("case_id"), "event_id", "value", (F.col("value") >= 50).alias("passed"))


def case_results(rows: DataFrame) -> DataFrame:
    """(system, case_id, n, passes, pass_all, pass_any, worst)."""
    return rows.groupBy("system", "case_id").agg(F.count("*").alias("n"), F.sum(F.col("passed").cast("long")).alias("passes"), F.min("passed").alias("pass_all"), F.max("passed").alias("pass_any"), F.min("value").alias("worst"))


def nearest_rank(value: str, q: float) -> Column:
    """The value at place ceil(q n) in order."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")


def system_stats(rows: DataFrame) -> DataFrame:
    cases = case_results(rows).groupBy("system").agg(F.count("*").alias("cases"), F.avg(F.col("pass_all").cast("double")).alias("all_rate"), F.avg(F.col("pass_any").cast("double")).alias("any_rate"), F.avg((F.col("pass_all") == F.col("pass_any")).cast("double")).alias("stability"))
    runs = rows.groupBy("system").agg(F.count("*").alias("trials"), F.sum(F.col("passed").cast("long")).alias("passed"), F.expr("percentile(value, 0.5)").alias("p50"), nearest_rank("value", 0.95).alias("p95"))
    low, high = wilson(F.col("passed"), F.col("trials"))
    joined = runs.join(cases, "system")
    return joined.select("system", "cases", "trials", "passed", *[F.round(c, 6).alias(n) for c, n in ((F.col("all_rate"), "all_rate"), (F.col("any_rate"), "any_rate"), (F.col("stability"), "stability"), (F.col("p50"), "p50"), (F.col("p95"), "p95"), (low, "low"), (high, "high"))])


def paired_systems(rows: DataFrame) -> DataFrame:
    """(a, b, both, a_only, b_only, neither) over the cases that two systems share."""
    cases = case_results(rows).select("system", "case_id", "pass_all")
    left = cases.select(F.col("system").alias("a"), "case_id", F.col("pass_all").alias("x"))
    right = cases.select(F.col("system").alias("b"), "case_id", F.col("pass_all").alias("y"))
    both = left.join(right, "case_id").where("a < b")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    x, y = F.col("x"), F.col("y")
    return both.groupBy("a", "b").agg(n(x & y)("both_pass"), n(x & ~y)("a_only"), n(~x & y)("b_only"), n(~x & ~y)("neither"))


def mcnemar_p(a_only: Column, b_only: Column) -> Column:
    """Exact two-sided McNemar probability of the discordant counts.

    Sums the binomial tail in logarithms, so large counts do not underflow.
    """
    n, low = (a_only + b_only).cast("double"), F.least(a_only, b_only).cast("int")
    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.lit(0.0).alias("total"))
    step = lambda acc, i: F.struct((acc["term"] + F.log((n - i) / (i + 1))).alias("term"), (acc["total"] + F.exp(acc["term"])).alias("total"))
    tail = F.aggregate(F.sequence(F.lit(0), low), start, step, lambda acc: acc["total"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def holm(rows: DataFrame, p: str, *group: str) -> DataFrame:
    """Step-down adjusted probabilities within each group of tests."""
    order = Window.partitionBy(*group).orderBy(p, "a", "b")
    size = F.count("*").over(Window.partitionBy(*group))
    step = F.least(F.lit(1.0), (size - F.row_number().over(order) + 1) * F.col(p))
    return rows.withColumn("_step", step).withColumn("p_holm", F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def bootstrap(rows: DataFrame, resamples: int = 1000, seed: int = 7) -> DataFrame:
    """(a, b, cases, difference, low, high): percentile interval of the paired difference.

    Only counts matter to a resample of 1, 0 and -1, so a pair's group is its counts.
    """
    counts = paired_systems(rows)

    def one(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in batch.itertuples():
            n = r.both_pass + r.a_only + r.b_only + r.neither
            draw = random.Random(f"{seed} {r.a} {r.b}")
            rng = np.random.default_rng(draw.getrandbits(64))
            picks = rng.multinomial(n, [r.a_only / n, r.b_only / n, 1 - (r.a_only + r.b_only) / n], resamples)
            d = np.sort((picks[:, 0] - picks[:, 1]) / n)
            out.append((r.a, r.b, n, (r.a_only - r.b_only) / n, float(d[int(0.025 * resamples)]), float(d[int(0.975 * resamples)])))
        return pd.DataFrame(out, columns=["a", "b", "cases", "difference", "low", "high"])

    return counts.mapInPandas(lambda it: (one(b) for b in it), "a string, b string, cases long, difference double, low double, high double")


def rank_metrics(relevant: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, mrr, ndcg) of ``ranked`` (query_id, item, rank) against ``relevant`` (query_id, item).

    Without relevant items recall is 1; the ideal gain has as many ones as could be had.
    """
    rel = relevant.select("query_id", "item").distinct()
    hits = ranked.where(F.col("rank") <= k).join(rel.withColumn("hit", F.lit(1)), ["query_id", "item"], "left")
    got = hits.groupBy("query_id").agg(F.count("*").alias("returned"), F.sum(F.coalesce("hit", F.lit(0))).alias("found"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum(F.when(F.col("hit") == 1, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("gain"))
    totals = rel.groupBy("query_id").agg(F.count("*").alias("relevant"))
    both = got.join(totals, "query_id", "full_outer").fillna(0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("relevant", "returned"), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1)))
    none = F.least("relevant", "returned") == 0
    return both.select(
        "query_id",
        F.round(F.when(F.col("relevant") == 0, 1.0).otherwise(F.col("found") / F.col("relevant")), 6).alias("recall"),
        F.round(F.when(F.coalesce("first", F.lit(0)) > 0, 1 / F.col("first")).otherwise(0.0), 6).alias("mrr"),
        F.round(F.when(none, 1.0).otherwise(F.col("gain") / ideal), 6).alias("ndcg"),
    )


def agreement(rows: DataFrame, left: str, right: str) -> DataFrame:
    """(n, agreement, kappa) of two yes-or-no judgements; kappa is 1 where chance already is."""
    a, b = F.col(left).cast("double"), F.col(right).cast("double")
    one = rows.agg(F.count("*").alias("n"), F.avg((F.col(left) == F.col(right)).cast("double")).alias("po"), F.avg(a).alias("pa"), F.avg(b).alias("pb"))
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return one.select("n", F.round("po", 6).alias("agreement"), F.round(F.when(chance >= 1, 1.0).otherwise((F.col("po") - chance) / (1 - chance)), 6).alias("kappa"))


def column_profile(table: DataFrame) -> DataFrame:
    """(column, type, rows, nulls, distinct) of every column, in one pass over the table."""
    kinds = dict(table.dtypes)
    parts = [F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("type"), F.count("*").alias("row_count"), F.sum(F.col(c).isNull().cast("long")).alias("null_count")) for c in table.columns]
    return table.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")
