"""Near-duplicate classes against all pairs."""

import random
import re

import numpy as np
import pytest

from strataloom.llm import common, near_dedup
from strataloom.llm.near_dedup import BINS, near_duplicates, signature

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(FOLD))
    if not words:
        return frozenset()
    width = min(5, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows):
    sets = {k: shingles(t) for k, t in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return sorted((k, len(s), find(k), find(k) == k) for k, s in sets.items())


def planted(seed, groups=25, copies=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        base = rng.choices(words, k=rng.randint(3, 160))
        for _ in range(rng.randint(1, copies)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows) * 7 % 1009, rng.choice([" ", "\n", "  "]).join(own)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs(spark, seed):
    rows = planted(seed)
    rows += [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "One"), (2004, "ONE"), (2005, "one two"), (2006, "É é"), (2007, "é É")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_chains_of_near_texts(spark):
    # each text is near the next, the ends are far from each other
    words = [f"c{i}" for i in range(300)]
    rows = [(100 - i, " ".join(words[4 * i : 4 * i + 100])) for i in range(30)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_link_among_many_bucket_mates(spark):
    # all hold one template and share buckets; only the two with fewest mates are near
    rng = random.Random(5)
    base = [f"t{i}" for i in range(204)]
    blocks = [[f"e{i}_{j}" for j in range(10)] for i in range(20)]
    rows = []
    for i in range(300):
        mine = rng.sample(blocks, 10)
        rows.append((i, " ".join(base + [w for block in mine for w in block])))
    for key, places in ((300, (50, 150)), (301, (20, 100, 180))):
        rows.append((key, " ".join(f"x{key}_{i}" if i in places else w for i, w in enumerate(base))))
    wanted = brute(rows)
    assert [c for k, _, c, _ in wanted if k == 301] == [300]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == wanted


def test_bridges_between_groups_of_near_copies(spark):
    # two cores with copies round each; only one pair joins the groups, and shares buckets with all
    rng = random.Random(12)
    rows = []
    for group in range(4):
        core = [f"g{group}w{i}" for i in range(400)]
        other = [w if i < 346 else f"g{group}o{i}" for i, w in enumerate(core)]
        for side, base in enumerate((core, other)):
            for copy in range(25):
                own = list(base)
                for place in rng.sample(range(0, 340), 2):
                    own[place] = f"g{group}s{side}c{copy}p{place}"
                rows.append((len(rows), " ".join(own)))
        near = [w if i < 346 or i > 352 else f"g{group}o{i}" for i, w in enumerate(core)]
        rows.append((len(rows), " ".join(near)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_words_that_simple_hashes_take_for_equal(spark):
    word = "0"
    for _ in range(10):
        word += word.translate(str.maketrans("01", "10"))
    rows = [(1, word), (2, word.translate(str.maketrans("01", "10")))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1, True), (2, 1, 2, True)]


def test_large_stars_and_hot_buckets_in_parts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HOT_ROWS", 8)
    monkeypatch.setattr(common, "HOT_ROWS", 8)
    rows = planted(3, groups=3, copies=60) + [(5000 + i, "same text for all of these rows here") for i in range(40)]
    rows += [(6000 + i, None) for i in range(20)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_few_rows_are_read_by_few_tasks(spark):
    """What a shuffle into many parts leaves of a small side costs no task a part in all later steps."""
    rows = planted(4, groups=6)
    parts = {"spark.sql.shuffle.partitions": "96", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in parts}
    context = spark.sparkContext
    try:
        for k, v in parts.items():
            spark.conf.set(k, v)
        context.setJobGroup("few rows", "")
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(tuple(r) for r in got) == brute(rows)
    tracker = context.statusTracker()
    stages = {i for job in tracker.getJobIdsForGroup("few rows") for i in tracker.getJobInfo(job).stageIds}
    tasks = [s.numCompletedTasks for s in map(tracker.getStageInfo, stages) if s]
    assert sum(n >= 96 for n in tasks) < 0.6 * sum(n > 0 for n in tasks)


def test_texts_longer_than_a_slice(spark):
    rng = random.Random(13)
    words = [f"long{rng.randrange(10**6)}" for _ in range(150_000)]
    other = [w if i % 40 else w + "x" for i, w in enumerate(words)]
    rows = [(3, " ".join(words)), (2, " ".join(other)), (1, "y" * 2_500_000), (4, "Y" * 2_500_000)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in near_duplicates(docs).collect()) == brute(rows)


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).count() == 0
    docs = spark.createDataFrame([(5, "a b", 1, "x"), (3, "A b", 2, None), (5, "a b", 1, "x"), (None, "q", 3, "y")], "doc_id long, text string, n_shingles int, component_id string")
    got = sorted(tuple(r) for r in near_duplicates(docs).where("doc_id is not null").collect())
    assert got == [(3, 1, 3, True), (5, 1, 3, False), (5, 1, 3, False)]
    assert near_duplicates(docs).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert near_duplicates(docs).count() == 4


def test_densified_signatures_estimate_similarity():
    random = np.random.default_rng(3)
    common = random.integers(0, 2**64, 60, dtype=np.uint64)
    errors = []
    for _ in range(40):
        own = [np.unique(np.concatenate([common, random.integers(0, 2**64, 10, dtype=np.uint64)])) for _ in range(2)]
        a, b = map(signature, own)
        errors.append((a == b).mean() - 60 / 80)
    assert len(a) == BINS and abs(np.mean(errors)) < 0.03


def test_estimated_sizes_do_not_multiply(spark, monkeypatch):
    """Sizes that Spark estimates for joins of joins stay short over the rounds; the driver holds every digit."""
    rng = random.Random(8)
    cuts = []
    plain = common.cut
    monkeypatch.setattr(common, "cut", lambda df: cuts.append(plain(df)) or cuts[-1])
    base = [f"t{i}" for i in range(204)]
    blocks = [[f"e{i}_{j}" for j in range(10)] for i in range(20)]
    rows = [(i, " ".join(base + [w for block in rng.sample(blocks, 10) for w in block])) for i in range(120)]
    rows += [(200 + i, " ".join(f"x{200 + i}_{at}" if at in places else w for at, w in enumerate(base))) for i, places in enumerate(((50, 150), (20, 100, 180)))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)
    # one of more than 4,300 digits can't even be read here
    assert max(df._jdf.queryExecution().analyzed().stats().sizeInBytes().bit_length() for df in cuts) < 4000
