"""Removal of repeats against a count of all windows, and the suffix array against sorting."""

import hashlib
import random
from collections import Counter

import numpy as np

from strataloom.llm.common import prefix_hashes, range_hashes
from strataloom.llm.suffix_dedup import GRAM, REACH, Phrases, _grams, cut_points, remove_repeats, suffix_ranks


def brute(rows, length=400):
    texts = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for key, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t)))
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((key, len(t), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def found(docs):
    return sorted((tuple(r) for r in remove_repeats(docs).drop("kept").collect()), key=repr)


def test_planted_repeats(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choices("abcdefghij éß ", k=n))
    shared = [text(n) for n in (300, 399, 400, 401, 700, 2500)]
    rows = []
    for i in range(60):
        own = "".join(rng.choice([text(rng.randint(0, 900)), rng.choice(shared)]) for _ in range(rng.randint(1, 6)))
        rows.append((i, own))
    rows += [(60, shared[4] * 3), (61, "a" * 1500), (62, "a" * 400), (63, "ab" * 500), (64, None), (65, ""), (66, rows[0][1]), (67, "x" * 401)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == brute(rows)


def test_periodic_texts(spark):
    rng = random.Random(6)
    unit = "".join(rng.choices("abcdef", k=130))
    rows = [(1, unit * 9), (2, unit * 4 + "tail"), (3, "head" + unit * 5), (4, unit[:77] * 8), (5, unit[5:] + unit * 3 + unit[:9])]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert found(docs) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_repeated_rows_null_keys_and_clashing_names(spark):
    rng = random.Random(5)
    text = "".join(rng.choices("abcdefghij", k=900))
    rows = [(1, text, 1), (1, text, 1), (None, text[:450], 2), (2, "short", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, core int")
    assert found(docs) == brute([r[:2] for r in rows])
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def thue_morse(steps):
    word = "0"
    for _ in range(steps):
        word += word.translate(str.maketrans("01", "10"))
    return word


def test_thue_morse_texts(spark):
    # polynomial hashes modulo a power of two take such words for equal
    word = thue_morse(10)
    other = word.translate(str.maketrans("01", "10"))
    rng = random.Random(8)
    noise = ["".join(rng.choices("xyz", k=120)) for _ in range(4)]
    rows = [(1, noise[0] + word + noise[1]), (2, noise[2] + other + noise[3])]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_text_longer_than_a_slice(spark):
    rng = random.Random(9)
    base = "".join(rng.choices("abcdefghij é\n", k=700_000))
    far = base[:1000] + "".join(rng.choices("uvwxyz", k=300_000)) + base[400_000:401_500] + base[261_000:263_500] + base[:399]
    rows = [(1, base), (2, far), (3, base[262_000:262_500])]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_one_passage_in_many_surroundings(spark):
    # one core with more neighbours than a part of the sort holds
    rng = random.Random(10)
    passage = "".join(rng.choices("abcdef", k=460))
    rows = []
    for i in range(900):
        a, b = rng.randrange(60), rng.randrange(60)
        rows.append((i, "".join(rng.choices("uvw", k=rng.randrange(4))) + passage[a : 460 - b] + "".join(rng.choices("xy", k=rng.randrange(5)))))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_suffix_ranks_order_all_suffixes(spark):
    rng = random.Random(7)
    strings = [rng.choices(range(3), k=rng.randint(1, 14)) for _ in range(40)] + [[1, 1, 1, 1, 1, 1], [0], [0]]
    rows = [(i, j, s) for i, string in enumerate(strings) for j, s in enumerate(string)]
    got = {(r.sid, r.idx): r["rank"] for r in suffix_ranks(spark.createDataFrame(rows, "sid long, idx long, s long"), 14).collect()}
    assert len(got) == len(rows)
    for place in range(3):
        heads = [(strings[i][j:], got[i, j]) for i, j, _ in rows if j == place]
        for a, x in heads:
            for b, y in heads:
                assert (a < b) == (x < y) and (a == b) == (x == y)


def test_parts_of_many_cores_at_once():
    rng = np.random.default_rng(6)
    sizes = [900, 0, 399, 400, 2500, 120, 1700]
    data = rng.integers(97, 103, sum(sizes), dtype=np.uint8)
    p = Phrases(data, np.concatenate([[0], np.cumsum(sizes)]), 0, 0, len(data), 400)
    which = np.arange(len(p.cut))[::2]
    got, edges = p.strings(which)
    assert len(which) > 20 and len(edges) == len(which) + 1
    for i, a, b in zip(which.tolist(), edges[:-1], edges[1:], strict=True):
        ends = np.array([p.core[0][i], *p.cuts[p.at[i] : p.chain[i] + 1], p.core[1][i]])
        assert (got[a:b] == range_hashes(prefix_hashes(data), ends[:-1], ends[1:]) >> np.uint64(1)).all()
    assert [len(x) for x in p.strings(which[:0])] == [0, 1]


def test_cuts_are_the_least_of_some_window():
    rng = np.random.default_rng(7)
    for _ in range(30):
        sizes = rng.integers(0, 400, rng.integers(1, 6))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        data = rng.integers(97, 97 + rng.integers(1, 26), offsets[-1], dtype=np.uint8)
        want = set()
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            for at in range(a, b - REACH - GRAM + 2):
                window = _grams(data)[at : at + REACH]
                want |= {at + int(i) for i in np.flatnonzero(window == window.min())}
        assert sorted(want) == cut_points(data, offsets).tolist()
