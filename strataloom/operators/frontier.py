"""Crawl frontiers and run progress from event logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.operators.ordered import running_sums


def latest_states(log: DataFrame, key: str, seq: str, state: str) -> DataFrame:
    """(key, state, attempts): each key's state of the latest log row and how often work on it began.

    One aggregation, combined before the shuffle; rows without a key or a sequence number
    are no log rows.
    """
    rows = log.where(F.col(key).isNotNull() & F.col(seq).isNotNull())
    begun = F.sum((F.col(state) == "processing").cast("long"))
    return rows.groupBy(key).agg(F.max_by(state, seq).alias("state"), F.coalesce(begun, F.lit(0)).alias("attempts"))


def pending(discovered: DataFrame, fetched: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``discovered`` that were not fetched yet."""
    return discovered.join(fetched.select(*on).distinct(), list(on), "left_anti")


def progress(log: DataFrame, run: str, seq: str, state: str) -> DataFrame:
    """(run, seq, saved, skipped, failed, processed): counters after each row of a run; runs of any length are dealt over tasks."""
    states = {name: F.coalesce(F.col(state) == name, F.lit(False)).cast("long") for name in ("saved", "skipped", "failed")}
    counted = running_sums(log.select(run, seq, state), [run], [seq], states)
    return counted.select(run, seq, *states, (F.col("saved") + F.col("skipped") + F.col("failed")).alias("processed"))


def regression_class(before: Column, after: Column) -> Column:
    """How a case changed between two runs, from structs (supported, passed) of it, null where a run lacks it.

    A case that the new run lacks is a regression, as a gate has to see it vanish; one that only the
    new run has, or has support for, is judged by itself.
    """
    passed = lambda run: run["passed"]
    return (
        F.when(after.isNull(), "regression")
        .when(~after["supported"], "unsupported")
        .when(before.isNull(), F.when(passed(after), "improvement").otherwise("persistent_gap"))
        .when(~before["supported"], "improvement")
        .when(passed(before) & ~passed(after), "regression")
        .when(~passed(before) & passed(after), "improvement")
        .when(~passed(after), "persistent_gap")
        .otherwise("unchanged")
    )


def best_per_target(runs: DataFrame, target: str, score: str, seq: str) -> DataFrame:
    """(target, score, seq): each target's best run, the first of several; a min-max aggregate, no window."""
    best = F.max(F.struct(F.col(score).alias("score"), (-F.col(seq)).alias("turn")))
    return runs.where(F.col(score).isNotNull()).groupBy(target).agg(best.alias("best")).select(target, F.col("best.score").alias(score), (-F.col("best.turn")).alias(seq))
