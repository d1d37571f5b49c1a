"""Contracts and gates against literal rows."""

from strataloom.operators import contracts as X

RECORD = "pack string, n int, document_id string, url string, title string, content string, content_hash string, fetched_at string, content_type string, mime_type string, schema_version int, token_count long, route struct<name:string>, rights struct<status:string>, chunk_index int, chunk_id string"
PACK = "pack string, artifacts array<string>, schema_version int, record_count long, has_record_citations boolean, has_allowed_use boolean, coverage_confidence string"
GATED = "pack string, record_count long, score_records long, audit_records long, pack_score int, audit_score int, coverage_confidence string, citation_coverage double, oldest_age_days double, eval_artifacts boolean, eval_generation string, redistribution string, model_training string, supported_ratio double, basis_issues int, pass_rate double"


def test_contract(spark):
    good = ("d", "u", "t", "text", "h", "2024", "page", "text/html", 3, 5, ("http",), ("unknown",), None, None)
    rows = [
        ("whole", 1, *good),
        ("whole", 2, "d2", "u", "t", " ", "h", "2024", "page", "text/html", 3, 0, ("http",), ("unknown",), 0, "c"),
        ("broken", 9, None, " ", "t", "text", "h", "2024", "page", None, 2, None, (None,), None, 1, ""),
        ("broken", 4, *good),
        ("alone", 1, *good),
    ]
    files = X.required_artifacts("eval")
    packs = [("whole", files, 3, 2, True, True, "high"), ("broken", files[:3], 2, 5, False, None, None), ("empty", files[1:], None, 7, None, False, "")]
    issues = X.contract_issues(spark.createDataFrame(rows, RECORD), spark.createDataFrame(packs, PACK), "pack", ["n"], "eval")
    got = {p: sorted((r.place or 0, r.code, r.field or "", r.severity) for r in issues.collect() if r.pack == p) for p in ("whole", "broken", "empty", "alone")}
    assert got["whole"] == [(2, "empty_content", "", "warning")]
    own = [(2, c, f, "issue") for c, f in (("missing_chunk_id", ""), ("missing_record_field", "document_id"), ("missing_record_field", "mime_type"), ("missing_record_field", "token_count"), ("missing_record_field", "url"), ("missing_rights_state", ""), ("missing_route_metadata", ""), ("record_schema_version", ""))]
    absent = [(0, "missing_artifact", f, "issue") for f in files[3:]]
    assert got["broken"] == sorted([*own, *absent, (0, "manifest_schema_version", "", "issue"), (0, "record_count_mismatch", "", "issue"), (0, "missing_record_citations", "", "issue")])
    assert got["empty"] == sorted([(0, "missing_artifact", files[0], "issue"), (0, "invalid_manifest", "", "issue"), (0, "rights_allowed_use_missing", "", "issue"), (0, "coverage_confidence_unknown", "", "warning")])
    assert got["alone"] == sorted([*((0, "missing_artifact", f, "issue") for f in files), (0, "invalid_manifest", "", "issue"), (0, "missing_record_citations", "", "issue")])
    states = {r.pack: (r.status, r.issue_count, r.warning_count) for r in X.contract_status(issues, spark.createDataFrame(packs, PACK), "pack").collect()}
    assert states == {"whole": ("pass", 0, 1), "broken": ("fail", 21, 0), "empty": ("fail", 3, 1)}


def gates(spark, row, asked, predictions=False):
    found = X.gate_rows(spark.createDataFrame([row], GATED), "pack", asked, predictions)
    report = X.gate_report(found, "pack").first()
    return {r.gate: r.status for r in found.collect()}, report


def test_gates(spark):
    good = ("p", 5, 5, 5, 80, 99, "high", 0.9, 10.0, True, "yes", "conditional", None, 0.8, 0, 0.8)
    all_pass, report = gates(spark, good, X.Thresholds(max_age_days=10, require_rights=["eval_generation", "redistribution"]), True)
    assert set(all_pass.values()) == {"pass"} and report.passed and report.gate_count == len(all_pass) == 12
    none = ("p", 5, *[None] * 14)
    found, report = gates(spark, none, X.Thresholds())
    assert found == {"pack_score_current": "fail", "pack_audit_current": "fail", "pack_score": "fail", "audit_score": "fail", "coverage_confidence": "warn", "citation_coverage": "fail", "max_age_days": "skip", "eval_grade_artifacts": "warn", "rights_status": "warn", "basis_quality": "warn", "context_prediction_pass_rate": "skip"}
    assert not report.passed and (report.fail_count, report.warn_count, report.skip_count) == (5, 4, 2)
    strict, _ = gates(spark, ("p", 5, 4, 5, 79, 80, "medium", 0.89, 10.5, True, "no", None, None, 0.9, 1, None), X.Thresholds(max_age_days=10, strict=True), True)
    assert strict == {"pack_score_current": "fail", "pack_audit_current": "pass", "pack_score": "fail", "audit_score": "pass", "coverage_confidence": "fail", "citation_coverage": "fail", "max_age_days": "fail", "eval_grade_artifacts": "pass", "rights_status": "pass", "basis_quality": "fail", "context_prediction_pass_rate": "fail"}
    assert gates(spark, ("p", 5, 5, 5, 90, 90, "low", 1.0, None, True, None, None, None, 0.9, 0, None), X.Thresholds(max_age_days=1))[0]["max_age_days"] == "warn"


TASK = "id string, source_url string, citation_id string, fail_if_contains array<string>, pack string"


def test_grading(spark):
    from strataloom.operators import grading as G

    tasks = [("a", "https://u", "S1", ["Bad"], "p"), ("b", "https://u", "S1", ["bad"], "p"), ("c", "https://u", None, [], "p"), ("d", None, None, [], "p"), ("e", "https://u", "S1", [], "q"), ("f", "https://u", "S1", [], "p")]
    said = [("a", "see https://u", 1), ("b", "S1 but BAD", 1), ("c", "S1 only", 1), ("d", "anything", 1), ("f", "https://u", 1), ("f", " ", 2), (None, "x", 1), ("z", "https://u", 1)]
    results = G.graded(spark.createDataFrame(tasks, TASK), spark.createDataFrame(said, "id string, answer string, seq int")).cache()
    got = {r.id: (r.status, r.passed) for r in results.collect()}
    assert got == {"a": ("graded", True), "b": ("graded", False), "c": ("graded", False), "d": ("graded", True), "e": ("missing_prediction", False), "f": ("graded", False)}
    rates = {r.pack: (r.tasks, r.graded, r.passed, r.pass_rate) for r in G.grading_summary(results, "pack").collect()}
    assert rates == {"p": (5, 5, 2, 0.4), "q": (1, 0, 0, None)}
    verdicts = spark.createDataFrame([("a", False), ("c", True), ("e", True), ("f", None)], "id string, correct boolean")
    for mode, want in (("llm", {"a": False, "c": True, "e": False, "f": False}), ("hybrid", {"a": True, "c": True, "e": False, "f": False})):
        judged = {r.id: r.passed for r in G.with_verdicts(results, verdicts, mode).collect()}
        assert {k: judged[k] for k in want} == want


def test_sentence_relations(spark):
    from strataloom.operators import mentions as M

    texts = [(1, "The SDK uses the API. Nothing here! An api supports\nthe MCP? " + "x" * 430 + " API SDK"), (2, "Only API."), (3, None)]
    names = [("e:api", ["API"]), ("e:mcp", ["MCP"]), ("e:sdk", ["SDK", "sdk"])]
    got = M.sentence_relations(spark.createDataFrame(texts, "doc_id long, content string"), spark.createDataFrame(names, "entity_id string, candidates array<string>"))
    assert sorted(map(tuple, got.collect())) == [(1, 0, "e:api", "e:sdk", "uses"), (1, 2, "e:api", "e:mcp", "supports")]
