"""Sinks of corpora: line-delimited JSON, flat tables and records for other tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_wins(records: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first in ``order``; rows without a key all stay."""
    first = Window.partitionBy(key).orderBy(*order)
    keyed = records.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return keyed.unionByName(records.where(F.col(key).isNull()))


def write_records(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Line-delimited JSON without null fields, in as many files as there are partitions."""
    records.write.mode(mode).option("ignoreNullFields", True).json(path)


def write_table(records: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """A flat table as parquet, csv or json; nested columns become JSON texts where csv needs it."""
    if kind == "csv":
        nested = [f.name for f in records.schema if f.dataType.typeName() in ("struct", "array", "map")]
        records = records.withColumns({c: F.to_json(c) for c in nested})
    writer = records.write.mode(mode).format(kind)
    if kind == "csv":
        writer = writer.option("header", True).option("escape", '"')
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def vector_records(records: DataFrame, id_column: str, text_column: str, metadata: list[str]) -> DataFrame:
    """(id, text, metadata): what vector stores load; metadata is JSON without nulls."""
    return records.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text"), F.to_json(F.struct(*metadata)).alias("metadata"))
