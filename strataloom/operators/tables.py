"""Profiles of tables, rankings within groups, samples and set operations on snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def column_profile(table: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, type, n_rows, n_null, n_blank, least, largest) of every column, in one pass.

    All figures are partial aggregates; only a row per column comes out.
    """
    names = list(columns or table.columns)
    text = {c: F.col(c).cast("string") for c in names}
    figures = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(table.schema[c].dataType.simpleString()).alias("type"),
            F.count("*").alias("n_rows"),
            F.sum(text[c].isNull().cast("long")).alias("n_null"),
            F.coalesce(F.sum((F.trim(text[c]) == "").cast("long")), F.lit(0)).alias("n_blank"),
            F.min(text[c]).alias("least"),
            F.max(text[c]).alias("largest"),
        ).alias(f"c{i}")
        for i, c in enumerate(names)
    ]
    one = table.agg(*figures)
    return one.select(F.explode(F.array(*[f"c{i}" for i in range(len(names))])).alias("p")).select("p.*")


def ranked_values(table: DataFrame, value: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The ``k`` most frequent values of each group, ties to the lesser value: by, rank, value, n."""
    counts = table.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*by).orderBy(F.col("n").desc(), F.col(value))
    return counts.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select(*by, "rank", value, "n")


def top_per_group(table: DataFrame, by: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """The first ``k`` rows of each group.

    Spark keeps only ``k`` rows of a group in each task before it shuffles, so a group
    that holds much of the table does not land in one task.
    """
    return table.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def gap_sessions(events: DataFrame, by: str, time: str, key: str, minutes: int) -> DataFrame:
    """(by, session, first, last, n): runs of events with no gap over ``minutes``."""
    order = Window.partitionBy(by).orderBy(time, key)
    gap = F.unix_micros(F.col(time).cast("timestamp")) - F.lag(F.unix_micros(F.col(time).cast("timestamp"))).over(order)
    new = F.when(gap.isNull() | (gap > minutes * 60_000_000), 1).otherwise(0)
    numbered = events.withColumn("_new", new).withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(by, "session").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n"))


def as_of(left: DataFrame, right: DataFrame, by: str, time: str, value: str) -> DataFrame:
    """``left`` with the last ``value`` of ``right`` at or before each row's time, null if there is none.

    Both sides are stacked and a running last value is taken over them, so each side is
    shuffled once and nothing is compared in pairs.
    """
    a = left.select(F.col(by).alias("_by"), F.col(time).alias("_time"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_value"), F.struct("*").alias("_row"))
    b = right.select(F.col(by).alias("_by"), F.col(time).alias("_time"), F.lit(0).alias("_side"), F.col(value).alias("_value"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    order = Window.partitionBy("_by").orderBy("_time", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("_last", F.last("_value", ignorenulls=True).over(order)).where("_side = 1").select("_row.*", F.col("_last").alias(f"{value}_as_of"))


def stratified_sample(table: DataFrame, by: str, key: str, per_group: int, seed: int = 0) -> DataFrame:
    """``per_group`` rows of each group, drawn by a hash of the key, the same for the same seed."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return top_per_group(table.withColumn("draw", draw), [by], ["draw", key], per_group).drop("draw")


def rows_in_order(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A digest per row over ``columns``, nulls apart from empty texts: what a fingerprint sums up."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    return table.select(F.sha2(F.concat_ws("\x1f", *parts), 256).alias("row_hash"))


def fingerprint(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(n_rows, fingerprint): the same for the same rows in any order.

    Digests are added up in eight words of 32 bits, so no list of them is gathered.
    """
    hashes = rows_in_order(table, columns)
    words = [F.coalesce(F.sum(F.conv(F.substring("row_hash", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")), F.lit(0)) for i in range(8)]
    joined = reduce(lambda a, b: F.concat(a, F.lit("-"), b), [w.cast("string") for w in words])
    return hashes.agg(F.count("*").alias("n_rows"), joined.alias("fingerprint"))
