"""Ordered merging, split joins and running sums against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from strataloom.operators import joins, merging
from strataloom.operators.ordered import running_sums


def folded(records):
    """(slot, winner) of records (seq, keys, quality) taken one after another."""
    held, output = {}, []
    for seq, keys, quality in sorted(records):
        keys = [k for k in keys or [] if k is not None]
        place = next((held[k] for k in keys if k in held), None)
        if place is None:
            output.append([seq, seq, keys, quality])
            held |= dict.fromkeys(keys, len(output) - 1)
        elif quality > output[place][3]:
            for k in output[place][2]:
                if held.get(k) == place:
                    del held[k]
            output[place][1:] = [seq, keys, quality]
            held |= dict.fromkeys(keys, place)
    return sorted((slot, winner) for slot, winner, _, _ in output)


def merged(spark, records):
    shuffled = records[:]
    random.Random(1).shuffle(shuffled)
    rows = spark.createDataFrame(shuffled, "n long, k array<string>, q array<long>").repartition(5)
    return sorted(map(tuple, merging.merge_records(rows, "n", F.col("k"), F.col("q")).collect()))


@pytest.mark.parametrize("seed", range(2))
def test_equals_the_loop(spark, seed, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 20)
    draw = random.Random(seed)
    keys = [f"k{i}" for i in range((30, 300)[seed])]
    records = [(i, draw.sample(keys, draw.randint(0, 4)), [draw.randint(0, 2), draw.randint(0, 30)]) for i in range(400)]
    assert merged(spark, records) == folded(records)


def test_hot_keys_and_chains(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 50)
    draw = random.Random(9)
    hot = [(i, [f"url{i}", "hash of an empty page"], [0, draw.randint(0, 40)]) for i in range(0, 3000, 3)]
    chain = [(i, [f"c{i // 3}", f"c{i // 3 + 1}"], [1, i % 5]) for i in range(1, 1200, 3)]
    rising = [(i, ["best", f"own{i % 7}", None], [i, 0]) for i in range(2, 900, 3)]
    odd = [(5000, None, [1]), (5001, [], [1]), (5002, ["a", "a"], [1]), (5003, ["a"], [1, 0]), (5004, [None], [3])]
    records = hot + chain + rising + odd
    assert merged(spark, records) == folded(records)
    assert merged(spark, [(1, ["a"], [1])] * 1) == [(1, 1)]


def test_empty_table(spark):
    none = spark.createDataFrame([], "n long, k array<string>, q array<long>")
    assert merging.merge_records(none, "n", F.col("k"), F.col("q")).count() == 0


def test_split_join_keeps_all_rows(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 10)
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i}") for i in range(100)] + [(100, None)], "n int, key string")
    side = spark.createDataFrame([("hot", 1), ("hot", 2), ("k4", 3), (None, 4)], "key string, v int")
    got = sorted(map(tuple, joins.join_split(rows, side, "key").select("n", "key", "v").collect()), key=repr)
    assert got == sorted(map(tuple, rows.join(side, "key", "left").select("n", "key", "v").collect()), key=repr)


def test_running_sums(spark):
    draw = random.Random(2)
    rows = [(draw.choice(["a", "b", None]) if i % 5 else "big", i, draw.randint(-5, 9)) for i in range(2000)]
    frame = spark.createDataFrame(rows, "g string, n int, v int").repartition(13)
    got = running_sums(frame, ["g"], ["n"], {"place": F.lit(1), "total": F.col("v")}).collect()
    want, so_far = {}, {}
    for g, n, v in rows:
        place, total = so_far.get(g, (0, 0))
        so_far[g] = want[n] = (place + 1, total + v)
    assert {r.n: (r.place, r.total) for r in got} == want and len(got) == 2000
