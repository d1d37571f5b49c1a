"""Questions made of records, hidden answers to them, and the grading of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions import text as T

# Kinds of tasks with their questions and what is asked beyond the common, and what no answer may hold.
KINDS = {
    "current-context-qa": ("Using only the current context, what does ", " say?", None),
    "version-drift": ("An older answer may be stale. Using the current context, what is the current behavior for ", "?", "flag stale or deprecated behavior when present"),
    "citation": ("Answer the question about ", " and cite the exact source that supports each claim.", "every material claim must map to a citation requirement"),
    "coverage-aware": ("Can this context pack confirm the current source-backed behavior for ", "? Answer only with supported citations.", "say when the pack does not provide enough evidence"),
}
COMMON = ["answer from current source content", "include citations for factual claims", "do not invent uncited parameters, APIs, or policy details"]
FAIL_TERMS = ["uncited answer", "I know from training data"]
STALE_TERMS = ["deprecated method without warning", "old SDK behavior", "pre-current context answer"]
DEPRECATION = r"(?i)\b(?:deprecated|deprecation|sunset|end[- ]of[- ]life|no longer supported|removed|obsolete)\b"
ALIASES = {"current-docs-qa": "current-context-qa"}


def claim(content: Column) -> Column:
    """The first sentence of 40 characters, else the whole text, of at most 420 characters; headings' marks and links' targets go before."""
    bare = F.regexp_replace(content, r"(?m)^\s{0,3}#{1,6}\s*", "")
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, r"\[([^\]]+)]\([^)]+\)", "$1"), r"\s+", " "))
    long = F.filter(F.transform(F.split(bare, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: F.length(s) >= 40)
    return T.truncated(F.coalesce(F.try_element_at(long, F.lit(1)), bare), 420)


def eval_tasks(records: DataFrame, citations: DataFrame, pack: str, kinds: Sequence[str] = tuple(KINDS), limit: int | None = None) -> DataFrame:
    """A row for each record with content and each kind of task: question, what is asked, what is required, and the hidden answer.

    ``records`` are (pack, url, title, content, content_hash) with a number ``place`` in order, ``citations`` (content_hash, citation_id)
    with one row a hash.  ``trap`` tells tasks whose source says that something is deprecated, or that ask for
    what has changed.  ``limit`` keeps a pack's first tasks, in the order of records and kinds.
    """
    named = list(dict.fromkeys(ALIASES.get(k, k) for k in kinds))
    unknown = [k for k in named if k not in KINDS]
    if unknown:
        raise ValueError(f"unknown kinds of tasks: {unknown}")
    rows = records.where(F.trim(F.coalesce("content", F.lit(""))) != "").join(citations, "content_hash", "left")
    title = F.coalesce(F.nullif("title", F.lit("")), "url")
    options = [F.struct(F.lit(i).alias("turn"), F.lit(k).alias("task_type"), F.concat(F.lit(KINDS[k][0]), title, F.lit(KINDS[k][1])).alias("input"), F.array(*map(F.lit, [*COMMON, *filter(None, [KINDS[k][2]])])).alias("required_behavior")) for i, k in enumerate(named)]
    made = rows.withColumn("claim", claim(F.col("content"))).withColumn("stale", F.col("content").rlike(DEPRECATION)).withColumn("k", F.explode(F.array(*options)))
    trap = F.col("stale") | (F.col("k.task_type") == "version-drift")
    if limit is not None:  # every record makes as many tasks, so a task's number follows from its record's
        made = made.where((F.col("place") - 1) * len(named) + F.col("k.turn") < limit)
    terms = lambda t: F.array(*map(F.lit, t))
    return made.select(
        T.stable_id("eval", F.col(pack), F.col("k.task_type"), F.col("url"), F.col("content_hash")).alias("id"), pack, "k.task_type", "k.input", "k.required_behavior",
        F.col("url").alias("source_url"), "citation_id", "content_hash", "claim", F.when(trap, terms([*FAIL_TERMS, *STALE_TERMS])).otherwise(terms(FAIL_TERMS)).alias("fail_if_contains"), trap.alias("trap"),
    )


def graded(tasks: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each task with (status, non_empty, has_url, has_citation, failed_terms, passed): an equi-join of tasks and answers.

    ``predictions`` are (id, answer, seq): of several with one id the last counts.  A prediction passes if it is not blank,
    holds the source's address or its citation where either is asked for, and none of what no
    answer may hold, whatever its case.  Predictions of no task are left out.
    """
    last = predictions.where("id is not null").groupBy("id").agg(F.max_by(F.struct(F.coalesce("answer", F.lit("")).alias("answer")), "seq").alias("p"))
    rows = tasks.join(last, "id", "left").withColumn("text", F.col("p.answer"))
    text = F.col("text")
    holds = lambda c: F.coalesce((F.col(c) != "") & F.contains(text, F.col(c)), F.lit(False))
    asked = (F.coalesce("source_url", F.lit("")) != "") | F.col("citation_id").isNotNull()
    failed = F.filter("fail_if_contains", lambda t: F.contains(F.lower(text), F.lower(t)))
    rows = rows.withColumns({"status": F.when(text.isNull(), "missing_prediction").otherwise("graded"), "non_empty": F.coalesce(F.trim(text) != "", F.lit(False)), "has_url": holds("source_url"), "has_citation": holds("citation_id"), "failed_terms": F.coalesce(failed, F.array().cast("array<string>"))})
    passed = F.col("non_empty") & (F.col("has_url") | F.col("has_citation") | ~asked) & (F.size("failed_terms") == 0)
    return rows.withColumn("passed", passed).drop("p", "text")


def with_verdicts(results: DataFrame, verdicts: DataFrame, mode: str) -> DataFrame:
    """Results with a judge's verdicts (id, correct): ``llm`` takes its word, ``hybrid`` passes what either passes.

    A task without a verdict keeps its result.
    """
    if mode not in ("llm", "hybrid"):
        raise ValueError(f"unknown mode {mode!r}")
    known = verdicts.where("correct is not null").groupBy("id").agg(F.bool_or("correct").alias("correct"))
    joined = results.join(known, "id", "left").withColumn("passed_deterministic", F.col("passed"))
    judged = F.col("correct") if mode == "llm" else F.col("passed") | F.col("correct")
    return joined.withColumn("passed", F.when((F.col("status") == "graded") & F.col("correct").isNotNull(), judged).otherwise(F.col("passed"))).drop("correct")


def grading_summary(results: DataFrame, by: str) -> DataFrame:
    """(by, tasks, graded, passed, pass_rate): the share of graded predictions that pass, null if there are none."""
    told = F.col("status") == "graded"
    counts = results.groupBy(by).agg(F.count("*").alias("tasks"), F.count_if(told).alias("graded"), F.count_if(told & F.col("passed")).alias("passed"))
    return counts.withColumn("pass_rate", F.when(F.col("graded") > 0, F.round(F.col("passed") / F.col("graded"), 6)))
