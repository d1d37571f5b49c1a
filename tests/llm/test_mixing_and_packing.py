"""Source mixing against a plain water level, packing against its own rules and bounds."""

import random
import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strataloom.llm.mixing import fit_lengths, mix_sources
from strataloom.llm import packing
from strataloom.llm.packing import best_fit_decreasing, lower_bound, pack_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = public_tokenizers.path("word_bpe_49k.json")


def targets(sizes):
    """Targets by repeated sharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] >= 3 * sizes[s]}
        if not full:
            out |= share
            break
        for s in full:
            out[s] = 3 * sizes[s]
            left -= 3 * sizes[s]
        free -= full
    return out


def check_mix(docs, rows):
    got = mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, source, text in rows:
        sizes[source] += len(WORD.findall(text or ""))
    want = targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.size * r.repeats and 0 <= r.repeats <= 3
        taken[r.source] += r.taken
    again = mix_sources(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in again if r.doc_id is not None) == sorted((r.doc_id, r.taken) for r in got if r.doc_id is not None)
    return want, taken


def test_mix_of_planted_sources(spark):
    rng = random.Random(2)
    rows = []
    for source, n in (("a", 4), ("b", 200), ("c", 30), (None, 3), ("é", 80), ("Z", 1)):
        for _ in range(n):
            rows.append((len(rows), source, " ".join(["w"] * rng.randint(0, 40)) if rng.random() > 0.05 else None))
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "'q' as size", "1 as target")
    want, taken = check_mix(docs, rows)
    for source, target in want.items():
        assert abs(taken[source] - target) <= 1, source


def test_mix_of_a_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    want, taken = check_mix(docs, rows)
    for source, target in want.items():
        assert abs(taken[source] - target) <= max(2, 0.02 * target)


def test_mix_of_empty_tables_and_texts(spark):
    kind = "doc_id long, source string, text string"
    assert mix_sources(spark.createDataFrame([], kind)).count() == 0
    got = mix_sources(spark.createDataFrame([(1, "a", None), (2, "b", "")], kind)).collect()
    assert [(r.size, r.taken) for r in got] == [(0, 0), (0, 0)]


def test_fit_is_the_best_sum():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(1, 30, 6)
        sizes, counts = np.unique(lengths, return_counts=True)
        target = float(rng.uniform(0, lengths.sum()))
        rounds, extra = fit_lengths(sizes, counts, target, 3)
        assert (extra <= counts).all() and (extra >= 0).all()
        sums = {sum(c) for k in range(7) for c in combinations(lengths.tolist(), k)}
        off = abs(rounds * lengths.sum() + (extra * sizes).sum() - round(target))
        # a share of each length is taken first, so the sum may miss the best by less than a document
        assert off <= min(abs(s - round(target)) for s in sums) + lengths.min()


def fewest(sizes, capacity):
    """Bins of the best packing, by search."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for j in {b: k for k, b in enumerate(bins)}.values():
            if bins[j] + sizes[i] <= capacity:
                bins[j] += sizes[i]
                place(i + 1, bins)
                bins[j] -= sizes[i]
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


def test_fit_of_few_long_documents():
    taken = lambda sizes, counts, target: (fit_lengths(np.array(sizes), np.array(counts), target, 3)[1] * sizes).sum()
    assert taken([100_000], [1], 60_000) == 100_000 and taken([100_000], [1], 40_000) == 0
    assert taken([10_000_000], [10**6], 6_000_000) == 10_000_000
    assert taken([30_000, 50_000], [2, 1], 57_000) == 60_000
    assert taken([30_000, 100_000], [2, 1], 100_000) == 100_000


def test_bounds_never_pass_the_best_packing():
    rng = np.random.default_rng(2)
    for _ in range(150):
        sizes = rng.integers(1, 21, rng.integers(1, 9))
        best, (bins, offsets) = fewest(sizes.tolist(), 20), best_fit_decreasing(sizes, 20)
        assert lower_bound(sizes, 20) <= best <= bins.max() + 1 <= 1.5 * best + 1
        for b in range(bins.max() + 1):
            own = np.flatnonzero(bins == b)
            own = own[np.argsort(offsets[own])]
            assert (offsets[own] == np.concatenate([[0], np.cumsum(sizes[own])[:-1]])).all() and sizes[own].sum() <= 20


def check_packed(rows, got, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want.append((key, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_packing_of_odd_texts(spark):
    rng = random.Random(3)
    texts = [None, "", "  ", "Hello, it's 2024!", "<|endoftext|> x", "É日本 ｆｕｌｌ 😀 don't", "İ İ ſ K", "á b", "word " * 9000, "12345 ½ x²"]
    texts += ["".join(rng.choices(["ab", "Cd ", "é", "7", "'ll ", "...", "\n", "Ü", "ñ ", "$%"], k=rng.randint(1, 4000))) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "no key")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as row", "1 as length")
    got = pack_documents(docs, PATH).collect()
    used = check_packed(rows, got, 2048)
    assert used <= lower_bound(np.array([r.length for r in got]), 2048) + 1


def test_packing_in_many_groups(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for group_rows in (20, 20_000):
        got = pack_documents(docs, PATH, group_rows=group_rows).collect()
        used = check_packed(rows, got, 2048)
        bound = lower_bound(np.array([r.length for r in got]), 2048)
        assert used <= bound * 1.03 + 2


def test_packing_of_an_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_new_words_of_many_texts_are_encoded_together():
    parts = ["'", "''", "'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'r", "'v", "'l", "s", "t", "re", "VE", "1", "23", "²", "½", "É", "İ", "ß", "ŉ", "ſ", "ª", "×", "\u00ad", "\u00a0", " ", "\n", "\t", ".", "--", "漢", "<|endoftext|>"]
    rng = random.Random(9)
    texts = ["".join(rng.choices(parts, k=rng.randrange(16))) for _ in range(3000)] + [f"new{i}word" + "x" * (i % 7) for i in range(1000)]
    encoder = packing.WordEncoder(PATH)
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    calls = []
    learn = encoder._learn
    encoder._learn = lambda words: (calls.append(len(words)), learn(words))
    assert encoder.encode(texts) == want
    assert len(calls) == 1
    assert encoder.encode(texts) == want and len(calls) == 1


def test_long_texts_and_forgotten_words_have_the_same_ids(monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 40)
    monkeypatch.setattr(packing, "LEARNED", 7)
    monkeypatch.setattr(packing, "REMEMBERED", 25)
    rng = random.Random(10)
    texts = ["".join(rng.choices(["it's", " ", " ", "we'll", "-", "é2", "wordy", "\n", "'"], k=rng.randrange(120))) + str(rng.random()) for _ in range(200)]
    encoder = packing.WordEncoder(PATH)
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [ids for at in range(0, len(texts), 9) for ids in encoder.encode(texts[at : at + 9])] == want
