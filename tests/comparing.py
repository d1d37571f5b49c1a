"""Results of Spark and DuckDB in a form that can be compared."""

from __future__ import annotations

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(row[c]) for c in columns) for row in df.collect()), key=repr)


def duck_rows(sql: str, sf_dir: str):
    with duckdb.connect() as con:
        for name in TABLES:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        columns = sorted(names)
        return columns, sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in found.fetchall()), key=repr)
