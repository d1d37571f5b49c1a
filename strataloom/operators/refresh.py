"""Refreshing a derived table after changes: only the partitions that hold changed records are built anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.lineage import cut

#: Partitions of a derived table; a record's rows are all in the one that its key's hash names.
PARTS = 64


def part_of(key: str, parts: int = PARTS):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts)).cast("int")


def _marks(records: DataFrame, key: str, digest: str, parts: int) -> DataFrame:
    """(part, key, digests): what a record's rows were when the table was built."""
    return records.groupBy(F.col(key).cast("string").alias("key")).agg(F.array_sort(F.collect_list(digest)).alias("digests")).withColumn("part", part_of("key", parts))


def build(records: DataFrame, path: str, key: str, digest: str, derive: Callable[[DataFrame], DataFrame], parts: int = PARTS) -> None:
    """Writes ``derive(records)``, which has to keep ``key``, by part, and the marks of the records beside it."""
    _write(records.sparkSession, derive(records).withColumn("part", part_of(key, parts)), f"{path}/rows", whole=True)
    _write(records.sparkSession, _marks(records, key, digest, parts), f"{path}/marks", whole=True)


def _write(spark: SparkSession, rows: DataFrame, path: str, whole: bool = False) -> None:
    mode = "static" if whole else "dynamic"
    rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("part").parquet(path)


def changed_parts(records: DataFrame, path: str, key: str, digest: str, parts: int = PARTS) -> DataFrame:
    """(part, added, removed, changed): how many records differ from those the table was built from, in each part where any do."""
    marks = records.sparkSession.read.parquet(f"{path}/marks").select(F.col("key"), F.col("digests").alias("old"))
    now = _marks(records, key, digest, parts).select("key", F.col("digests").alias("new"))
    both = now.join(marks, "key", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    count = lambda c: F.count_if(c)
    return both.groupBy(part_of("key", parts).alias("part")).agg(count(F.col("old").isNull()).alias("added"), count(F.col("new").isNull()).alias("removed"), count(F.col("old").isNotNull() & F.col("new").isNotNull()).alias("changed"))


def refresh(records: DataFrame, path: str, key: str, digest: str, derive: Callable[[DataFrame], DataFrame], parts: int = PARTS) -> DataFrame:
    """Brings the table at ``path`` up to ``records`` and returns the parts that it rewrote, as ``changed_parts``.

    ``derive`` has to make a record's rows from that record alone.  Parts without changes are not
    touched.  Rows are written before marks, so a refresh that was cut short is done again by the next; one
    that finds nothing to do writes nothing.  A part whose records are all gone is left with no rows.
    """
    spark = records.sparkSession
    touched = cut(changed_parts(records, path, key, digest, parts))
    if touched.isEmpty():
        return touched
    which = F.broadcast(touched.select("part"))  # at most ``parts`` rows
    here = records.withColumn("part", part_of(key, parts)).join(which, "part", "left_semi").drop("part")
    rows = cut(derive(here).withColumn("part", part_of(key, parts)))
    marks = cut(_marks(here, key, digest, parts))
    for made, name in ((rows, "rows"), (marks, "marks")):
        _write(spark, made, f"{path}/{name}")
        empty = [r["part"] for r in touched.join(made.select("part").distinct(), "part", "left_anti").collect()]
        for part in empty:  # dynamic overwriting leaves a part alone of which nothing is written
            made.limit(0).drop("part").coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}/part={part}")
    return touched


def status(records: DataFrame, path: str, key: str, digest: str, parts: int = PARTS) -> str:
    """current, or stale if any record differs."""
    return "current" if changed_parts(records, path, key, digest, parts).isEmpty() else "stale"
