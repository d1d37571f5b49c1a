"""Contracts that packs have to keep, and gates that let them pass, for any number of packs at once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.operators.ordered import running_sums
from strataloom.operators.rights import status as rights_status

VERSION = 3
# The artifacts of each level, each with those of the level before, and the fields of a record.
ARTIFACTS = {
    "raw": ["corpus.manifest.json", "sources.md", "acquisition.routes.json"],
    "agent": ["context.lock.json", "coverage.report.json", "citation.index.json", "pack.score.json", "pack.audit.json"],
    "eval": ["rights.manifest.json", "provenance.graph.json", "basis.ndjson", "basis.report.json", "PACK_CARD.md"],
}
TEXT_FIELDS = ["document_id", "url", "title", "content_hash", "fetched_at", "content_type", "mime_type"]
RIGHTS = ["eval_generation", "redistribution", "model_training"]


def required_artifacts(level: str) -> list[str]:
    levels = list(ARTIFACTS)
    if level not in levels:
        raise ValueError(f"unknown level {level!r}")
    return [name for one in levels[: levels.index(level) + 1] for name in ARTIFACTS[one]]


def record_issues() -> Column:
    """An array of (code, field, severity): what is wrong with a record by itself."""
    issue = lambda when, code, name=None, severity="issue": F.when(F.coalesce(when, F.lit(True)), F.struct(F.lit(code).alias("code"), F.lit(name).cast("string").alias("field"), F.lit(severity).alias("severity")))
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    checks = [issue(blank(c), "missing_record_field", c) for c in TEXT_FIELDS]
    checks += [
        issue(~F.col("schema_version").eqNullSafe(F.lit(VERSION)), "record_schema_version"),
        issue(F.col("token_count").isNull(), "missing_record_field", "token_count"),
        issue(F.coalesce(F.col("route.name"), F.lit("")) == "", "missing_route_metadata"),
        issue(F.coalesce(F.col("rights.status"), F.lit("")) == "", "missing_rights_state"),
        issue(F.col("chunk_index").isNotNull() & (F.coalesce("chunk_id", F.lit("")) == ""), "missing_chunk_id"),
        issue(blank("content"), "empty_content", None, "warning"),
    ]
    return F.array_compact(F.array(*checks))


def contract_issues(records: DataFrame, packs: DataFrame, pack: str, order: list[str], level: str = "raw") -> DataFrame:
    """(pack, place, code, field, severity) for all packs.

    ``place`` numbers a record within its pack from 1, in ``order``, and is null for what concerns the pack.
    ``packs`` are (pack, artifacts, schema_version, record_count, has_record_citations, has_allowed_use, coverage_confidence): the
    files that are there, and what the manifest and the other files say; packs of records that are not among
    them lack everything.  A pack without records is checked too.
    """
    placed = running_sums(records.withColumn("_issues", record_issues()), [pack], order, {"place": F.lit(1)})
    own = placed.select(pack, "place", F.explode("_issues").alias("i")).select(pack, "place", "i.code", "i.field", "i.severity")
    loaded = records.groupBy(F.col(pack).alias("_pack")).agg(F.count("*").alias("loaded"))
    all_packs = packs.join(loaded, F.col(pack).eqNullSafe(F.col("_pack")), "full_outer").withColumn(pack, F.coalesce(pack, "_pack")).fillna(0, ["loaded"])
    there = F.coalesce("artifacts", F.array().cast("array<string>"))
    missing = F.transform(F.filter(F.array(*map(F.lit, required_artifacts(level))), lambda a: ~F.array_contains(there, a)), lambda a: F.struct(F.lit("missing_artifact").alias("code"), a.alias("field"), F.lit("issue").alias("severity")))
    one = lambda when, code, severity="issue": F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(None).cast("string").alias("field"), F.lit(severity).alias("severity")))
    manifest = F.array_contains(there, "corpus.manifest.json")
    held = lambda name: F.array_contains(there, name)
    wrong = [
        one(~manifest, "invalid_manifest"),
        one(manifest & ~F.col("schema_version").eqNullSafe(F.lit(VERSION)), "manifest_schema_version"),
        one((F.col("loaded") > 0) & (F.col("record_count") != F.col("loaded")), "record_count_mismatch"),
        one((F.col("loaded") > 0) & ~F.coalesce("has_record_citations", F.lit(False)), "missing_record_citations"),
    ]
    if level in ("agent", "eval"):
        wrong.append(one(held("coverage.report.json") & (F.coalesce("coverage_confidence", F.lit("")) == ""), "coverage_confidence_unknown", "warning"))
    if level == "eval":
        wrong.append(one(held("rights.manifest.json") & ~F.coalesce("has_allowed_use", F.lit(False)), "rights_allowed_use_missing"))
    whole = all_packs.select(pack, F.explode(F.concat(missing, F.array_compact(F.array(*wrong)))).alias("i"))
    return own.unionByName(whole.select(pack, F.lit(None).cast("long").alias("place"), "i.code", "i.field", "i.severity"))


def contract_status(issues: DataFrame, packs: DataFrame, pack: str) -> DataFrame:
    """(pack, status, issue_count, warning_count, missing_artifacts); packs without issues pass."""
    counted = issues.groupBy(F.col(pack).alias("_pack")).agg(F.count_if(F.col("severity") == "issue").alias("issue_count"), F.count_if(F.col("severity") == "warning").alias("warning_count"), F.count_if(F.col("code") == "missing_artifact").alias("missing_artifacts"))
    joined = packs.select(pack).distinct().join(counted, F.col(pack).eqNullSafe(F.col("_pack")), "left").fillna(0, ["issue_count", "warning_count", "missing_artifacts"])
    return joined.select(pack, F.when(F.col("issue_count") == 0, "pass").otherwise("fail").alias("status"), "issue_count", "warning_count", "missing_artifacts")


@dataclass
class Thresholds:
    """What gates ask for; ``strict`` fails packs of medium coverage and of weak evidence instead of warning."""

    pack_score: int = 80
    audit_score: int = 80
    citation_coverage: float = 0.9
    pass_rate: float = 0.8
    supported_ratio: float = 0.8
    max_age_days: int | None = None
    require_rights: list[str] = field(default_factory=list)
    strict: bool = False


def gate_rows(packs: DataFrame, pack: str, asked: Thresholds, predictions: bool = False) -> DataFrame:
    """(pack, gate, status, value, threshold) for all packs: pass, warn, fail or skip.

    ``packs`` are (pack, record_count, score_records, audit_records, pack_score, audit_score, coverage_confidence,
    citation_coverage, oldest_age_days, eval_artifacts, RIGHTS, supported_ratio, basis_issues, pass_rate).  A null counts as the
    file that would tell not being there.  With ``predictions``, a pack without graded ones fails, and
    weak evidence fails too.
    """
    text = lambda c: c.cast("string")
    nothing = F.lit(None).cast("string")

    def gate(name: str, status: Column, value: Column = nothing, threshold: object = None) -> Column:
        return F.struct(F.lit(name).alias("gate"), status.alias("status"), text(value).alias("value"), F.lit(None if threshold is None else str(threshold)).cast("string").alias("threshold"))

    at_least = lambda c, least: F.when(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) >= F.lit(float(least)), "pass").otherwise("fail")
    current = lambda c: F.when(F.col(c).isNotNull() & (F.col(c) == F.col("record_count")), "pass").otherwise("fail")
    confidence = F.coalesce("coverage_confidence", F.lit("unknown"))
    firm = "fail" if asked.strict or predictions else "warn"
    weak = F.when(F.col("supported_ratio").isNull() | (F.coalesce("basis_issues", F.lit(0)) > 0) | (F.col("supported_ratio") < asked.supported_ratio), firm).otherwise("pass")
    gates = [
        gate("pack_score_current", current("score_records")),
        gate("pack_audit_current", current("audit_records")),
        gate("pack_score", at_least("pack_score", asked.pack_score), F.coalesce("pack_score", F.lit(0)), asked.pack_score),
        gate("audit_score", at_least("audit_score", asked.audit_score), F.coalesce("audit_score", F.lit(0)), asked.audit_score),
        gate("coverage_confidence", F.when(confidence == "low", "fail").when(confidence == "medium", "fail" if asked.strict else "warn").when(confidence == "unknown", "warn").otherwise("pass"), confidence),
        gate("citation_coverage", at_least("citation_coverage", asked.citation_coverage), F.coalesce("citation_coverage", F.lit(0.0)), asked.citation_coverage),
    ]
    if asked.max_age_days is None:
        gates.append(gate("max_age_days", F.lit("skip")))
    else:
        age = F.col("oldest_age_days")
        gates.append(gate("max_age_days", F.when(age.isNull(), "warn").when(age <= asked.max_age_days, "pass").otherwise("fail"), F.round(age, 3), asked.max_age_days))
    gates.append(gate("eval_grade_artifacts", F.when(F.coalesce("eval_artifacts", F.lit(False)), "pass").otherwise("warn")))
    rights = {use: rights_status(F.col(use)) for use in RIGHTS}
    if asked.require_rights:
        for use in asked.require_rights:
            gates.append(gate(f"rights_{use}", F.when(rights[use].startswith("allowed"), "pass").otherwise("fail"), rights[use], "allowed_or_allowed_with_conditions"))
    else:
        known = F.exists(F.array(*rights.values()), lambda s: s != "unknown")
        gates.append(gate("rights_status", F.when(known, "pass").otherwise("warn")))
    gates.append(gate("basis_quality", weak, F.col("supported_ratio"), asked.supported_ratio))
    rate = F.col("pass_rate")
    gates.append(gate("context_prediction_pass_rate", F.when(rate.isNull() | (rate < asked.pass_rate), "fail").otherwise("pass"), rate, asked.pass_rate) if predictions else gate("context_prediction_pass_rate", F.lit("skip")))
    return packs.select(pack, F.explode(F.array(*gates)).alias("g")).select(pack, "g.*")


def gate_report(gates: DataFrame, pack: str) -> DataFrame:
    """(pack, passed, counts of each status): a pack passes if no gate fails."""
    counts = [F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("pass", "warn", "fail", "skip")]
    return gates.groupBy(pack).agg(F.bool_and(F.col("status") != "fail").alias("passed"), F.count("*").alias("gate_count"), *counts)
