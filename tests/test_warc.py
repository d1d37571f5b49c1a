"""WARC files made by hand: round trips, splits, several records in a member, and damage."""

import gzip
import hashlib
import random

import pytest

from strataloom.sources.warc import _members, read_warc, record_bytes, write_warc


def records(n, seed=1):
    draw = random.Random(seed)
    # bodies that hold what looks like members and headers
    return [(f"https://a.example/{i}", draw.randbytes(draw.randint(0, 3000)) + draw.choice([b"", b"\x1f\x8b\x08\x00", b"\r\n\r\nWARC/1.1\r\n", b"\r\n"]) + "é".encode() * draw.randint(0, 40)) for i in range(n)]


@pytest.mark.parametrize("split", [1 << 26, 5000, 700])
def test_round_trip_in_splits(spark, tmp_path, split):
    rows = records(120)
    for k in range(2):
        (tmp_path / f"{k}.warc.gz").write_bytes(b"".join(record_bytes(u, b) for u, b in rows[k::2]))
    got = read_warc(spark, str(tmp_path), split_bytes=split)
    assert got.rdd.getNumPartitions() >= (2 if split > 1 << 20 else 20)
    found = got.collect()
    assert sorted((r.target_uri, bytes(r.payload)) for r in found) == sorted(rows)
    assert all(r.error is None and r.warc_type == "resource" and r.length == len(r.payload) and r.payload_digest == "sha256:" + hashlib.sha256(r.payload).hexdigest() for r in found)
    assert len({(r.file, r.offset, r.record) for r in found}) == 120


def test_only_what_is_asked_for(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(record_bytes(u, b) for u, b in records(9)))
    got = read_warc(spark, f"file://{tmp_path}", ["target_uri", "length"])
    assert got.columns == ["target_uri", "length"] and got.count() == 9
    with (tmp_path / "a.warc.gz").open("rb") as file:
        assert all(r["payload"] is None and r["payload_digest"] is None for r in _members(file, 0, 1 << 30, False, False))


def test_one_member_and_plain_files(spark, tmp_path):
    rows = records(40)
    plain = b"".join(gzip.decompress(record_bytes(u, b)) for u, b in rows)
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(plain))
    (tmp_path / "two.warc").write_bytes(plain)
    (tmp_path / "no.txt").write_text("other")
    got = read_warc(spark, str(tmp_path), ["file", "record", "target_uri", "payload"], split_bytes=3000).collect()
    for name in ("one.warc.gz", "two.warc"):
        own = sorted((r.record, r.target_uri, bytes(r.payload)) for r in got if r.file.endswith(name))
        assert own == [(i, u, b) for i, (u, b) in enumerate(rows)]


def test_damage_is_told_and_passed_over(spark, tmp_path):
    rows = records(30)
    members = [record_bytes(u, b) for u, b in rows]
    members[5] = members[5][:20] + bytes([members[5][20] ^ 255]) + members[5][21:]
    members[9] = gzip.compress(b"no record at all")
    members[12] = gzip.compress(b"WARC/1.1\r\nContent-Length: 999\r\n\r\nshort")
    members[29] = members[29][:-9]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    for split in (1 << 26, 2000):
        got = read_warc(spark, str(tmp_path), ["target_uri", "error"], split_bytes=split).collect()
        assert {rows[i][0] for i in range(30) if i not in (5, 9, 12, 29)} <= {r.target_uri for r in got}
        assert len([r for r in got if r.error]) >= 3 and not {rows[i][0] for i in (9, 12)} & {r.target_uri for r in got}


def test_writing_and_reading_pages(spark, tmp_path):
    pages = spark.createDataFrame([("u1", "<p>é</p>"), ("u2", None), (None, "x"), ("u1", "<p>é</p>")], "url string, html string").repartition(2)
    write_warc(pages, str(tmp_path / "w"))
    got = sorted((r.target_uri, bytes(r.payload).decode()) for r in read_warc(spark, str(tmp_path / "w")).collect())
    assert got == [("", "x"), ("u1", "<p>é</p>"), ("u1", "<p>é</p>"), ("u2", "")]
