"""All queries of the library's own operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataloom.plans import analytics, changes, contracts, documents, extraction, governance, packs, pages, project, runs, streams

MODULES = (pages, documents, analytics, extraction, runs, changes, project, streams, governance, packs, contracts)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
