"""Change events against rows worked out by hand."""

import hashlib

from strataloom.operators import changes as H

SHAPE = "url string, document_id string, title string, content string, content_hash string, seq int"


def _events(spark, old, new):
    rows = H.change_events(spark.createDataFrame(old, SHAPE), spark.createDataFrame(new, SHAPE), "seq").collect()
    return {r["url"]: r for r in rows}


def test_events_of_each_kind(spark):
    old = [
        ("same", "1", "T", "one", "h1", 1),
        ("gone", "2", "T", "a\nb", "h2", 1),
        ("edited", "3", "T", "a\nb\nc", "h3", 1),
        ("renamed", "4", "Old", "x", "h4", 1),
        (None, "5", "T", "no url", "h5", 1),
        ("grown", "7", "T", "x", "h7", 1),
    ]
    new = [
        ("same", "1", "T", "one", "h1", 1),
        ("edited", "3", "T", "a\nB price\nc\nd", "h3b", 1),
        ("renamed", "4", "New", "x", "h4", 1),
        ("come", "6", None, None, None, 1),
        ("grown", "8", "T", "second", "h8", 2),
        ("grown", "7", "T", "x", "h7", 1),
    ]
    found = _events(spark, old, new)
    assert {u: list(r["structural"]) for u, r in found.items()} == {
        "gone": ["document_removed", "record_count_changed", "title_changed"],
        "edited": [],
        "renamed": ["title_changed"],
        "come": ["document_added", "record_count_changed", "title_changed"],
        "grown": ["record_count_changed"],
    }
    edits = [(e["type"], e["old_line_start"], e["old_line_end"], e["new_line_start"], e["new_line_end"], e["before"], e["after"]) for e in found["edited"]["textual"]]
    assert edits == [("replace", 1, 2, 1, 2, "b", "B price"), ("insert", 3, 3, 3, 4, "", "d")]
    assert found["edited"]["textual"][0]["before_sha256"] == hashlib.sha256(b"b").hexdigest()
    assert [e["type"] for e in found["gone"]["textual"]] == ["delete"]
    assert found["come"]["textual"] == [] and found["renamed"]["textual"] == []
    assert found["grown"]["new_content"] == "x\n\nsecond" and found["grown"]["new_first_id"] == "7"
    assert ("pricing", 0.6) in [(c["classification"], c["confidence"]) for c in found["edited"]["candidates"]]
    assert [(c["classification"], c["confidence"]) for c in found["come"]["candidates"]] == [("other", 0.4)]


def test_keys_repeat_and_tables_may_be_empty(spark):
    old, new = [("u", "1", "T", "a", "h1", 1)], [("u", "1", "T", "b", "h2", 1)]
    assert _events(spark, old, new)["u"]["idempotency_key"] == _events(spark, old, new)["u"]["idempotency_key"]
    assert _events(spark, [], new)["u"]["structural"] == ["document_added", "record_count_changed", "title_changed"]
    assert _events(spark, [], []) == {}


def test_edits_and_their_sides_are_bounded(spark):
    a, b = "\n".join(f"{i}\nsame" for i in range(150)), "\n".join(f"{'n' * 1500}{i}\nsame" for i in range(150))
    edits = _events(spark, [("u", "1", "T", a, "h1", 1)], [("u", "1", "T", b, "h2", 1)])["u"]["textual"]
    assert len(edits) == 100 and {len(e["after"]) for e in edits} == {1000}
