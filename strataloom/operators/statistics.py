"""Statistics of evaluation runs: intervals, exact tests and paired comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: the normal quantile of a 95 % interval.
Z95 = 1.959963984540054


def wilson(successes: Column, total: Column, z: float = Z95) -> tuple[Column, Column]:
    """(low, high) of the score interval of a rate; null without trials."""
    n = F.when(total > 0, total.cast("double"))
    p = successes / n
    middle = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    low, high = F.greatest(F.lit(0.0), (middle - half) / scale), F.least(F.lit(1.0), (middle + half) / scale)
    return F.when(total > 0, low), F.when(total > 0, high)


def nearest_ranks(rows: DataFrame, by: list[str], value: str, ranks: dict[str, float]) -> DataFrame:
    """The values at places ceil(q n) of each group in order, at least the first; null without values.

    Rows become counts of distinct values before anything is shuffled, and the running
    count over these finds the places, so no group is gathered.
    """
    counts = rows.groupBy(*by, value).agg(F.count(value).alias("_n"))
    order = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_first())
    upto = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.select(*by, value, upto.alias("_upto"), F.sum("_n").over(Window.partitionBy(*by)).alias("_all"))
    found = [F.min(F.when((F.col("_all") > 0) & (F.col("_upto") >= F.greatest(F.ceil(F.lit(q) * F.col("_all")), F.lit(1))), F.col(value))).alias(name) for name, q in ranks.items()]
    return placed.groupBy(*by).agg(*found)


def exact_mcnemar(a_only: Column, b_only: Column) -> Column:
    """Two-sided binomial tail of the discordant pairs; 1 without any.

    Terms are made from logarithms, each from the one before it, so many pairs do not
    overflow.
    """
    n, k = (a_only + b_only).cast("int"), F.least(a_only, b_only).cast("int")
    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))
    step = lambda acc, i: acc["term"] + F.log((n - i + 1) / i)
    places = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(places, start, lambda acc, i: F.struct(step(acc, i).alias("term"), (acc["sum"] + F.exp(step(acc, i))).alias("sum")), lambda acc: acc["sum"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def holm(tests: DataFrame, p: str = "p_value", by: tuple[str, ...] = (), ties: tuple[str, ...] = ()) -> DataFrame:
    """``tests`` with ``p_adjusted``: the step-down running maximum within each family ``by``."""
    family = Window.partitionBy(*by)
    order = family.orderBy(p, *ties)
    scaled = F.least(F.lit(1.0), F.col(p) * (F.count("*").over(family) - F.row_number().over(order) + 1))
    return tests.withColumn("_scaled", scaled).withColumn("p_adjusted", F.max("_scaled").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_scaled")


def paired(trials: DataFrame, case: str, system: str, passed: str) -> DataFrame:
    """(a, b, cases, both, a_only, b_only, p_value) for every two systems on the cases that both have.

    Trials of a system are joined per case; a case has one row per system, so pairs grow
    with the systems and not with the cases.
    """
    one = trials.groupBy(case, system).agg(F.min(F.col(passed).cast("int")).alias("ok"))
    sides = [one.select(F.col(case), F.col(system).alias(s), F.col("ok").alias(f"{s}_ok")) for s in ("a", "b")]
    met = sides[0].join(sides[1], case).where("a < b")
    counts = met.groupBy("a", "b").agg(
        F.count("*").alias("cases"),
        F.sum(F.col("a_ok") * F.col("b_ok")).alias("both"),
        F.sum(F.col("a_ok") * (1 - F.col("b_ok"))).alias("a_only"),
        F.sum((1 - F.col("a_ok")) * F.col("b_ok")).alias("b_only"),
    )
    return counts.withColumn("p_value", exact_mcnemar(F.col("a_only"), F.col("b_only")))


def pass_all(trials: DataFrame, case: str, system: str, score: str, threshold: float) -> DataFrame:
    """(system, cases, passed, pass_rate): a case passes if its worst trial reaches the threshold."""
    worst = trials.groupBy(system, case).agg(F.min(score).alias("worst"))
    share = F.avg((F.col("worst") >= threshold).cast("double"))
    return worst.groupBy(system).agg(F.count("*").alias("cases"), F.sum((F.col("worst") >= threshold).cast("long")).alias("passed"), share.alias("pass_rate"))
