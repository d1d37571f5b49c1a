"""Aligned tokens against every pair of tokens compared, and the encoders against the files' libraries."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from strataloom.llm import token_alignment
from strataloom.llm.token_alignment import ByteLevel, Pieces, align_tokenizers

FILES = (P.path("byte_bpe_50k.json"), P.PATTERN, P.path("piece_bpe_32k.model"))


def ranges(ids, spelled):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(spelled[i]), i))
        at += len(spelled[i])
    return out


def brute(docs):
    """From (key, text) rows, with the files' own libraries."""
    first = Tokenizer.from_file(FILES[0])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=FILES[2])
    a_bytes, b_bytes = ByteLevel(*FILES[:2]).bytes, Pieces(FILES[2]).bytes
    links, rows, counts = {}, {}, Counter()
    for key, text in docs:
        a, b = first.encode(" " + (text or ""), add_special_tokens=False).ids, second.encode(text or "")
        want = b" " + (text or "").encode()
        if not text or b"".join(a_bytes[i] for i in a) != want or b"".join(b_bytes[i] for i in b) != want:
            links[key], rows[key] = [], (0, 0, 0, "")
            continue
        ra, rb = ranges(a, a_bytes), ranges(b, b_bytes)
        at, found = 0, []
        for s, e, i in ra:
            while rb[at][1] <= s:
                at += 1
            k = at
            while k < len(rb) and rb[k][0] < e:
                found.append((i, rb[k][2]))
                k += 1
        links[key] = found
        counts.update(found)
        ends = sorted({e for _, e, _ in ra} & {e for _, e, _ in rb})
        groups, low = [], 0
        ia = ib = 0
        for end in ends:
            ja, jb = ia, ib
            while ja < len(ra) and ra[ja][1] <= end:
                ja += 1
            while jb < len(rb) and rb[jb][1] <= end:
                jb += 1
            groups.append(",".join(str(x[2]) for x in ra[ia:ja]) + "|" + ",".join(str(x[2]) for x in rb[ib:jb]))
            ia, ib, low = ja, jb, end
        assert low == len(want)
        rows[key] = (len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest())
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return sorted(((k, *rows[k][:3], len(x), sum(counts[p] == highest[p[1]] for p in x), sum(counts[p] for p in x), rows[k][3]) for k, x in links.items()), key=repr)


def test_whole_table(spark):
    from strataloom.llm.queries import op11_tokenizer_alignment

    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = op11_tokenizer_alignment(spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs)


ODD = [
    (1, None), (2, ""), (3, "<|endoftext|> and <s> </s> <unk> <0x41>"), (4, "▁ stands for a space"), (5, "  two  spaces\n\n\ttabs \r\n"), (6, "日本語 テキスト 🙂🙂 é ﬁ"),
    (7, "word" * 3000), (8, " " * 5000), (9, "a"), (None, "no key"), (11, "zero\x00byte"), (12, "Ünïcödé — “quotes” 12345 x1y2"),
]


@pytest.mark.parametrize("most", [1 << 22, 20])
def test_odd_texts(spark, monkeypatch, most):
    monkeypatch.setattr(token_alignment, "SHARED_PAIRS", most)  # beyond it, rare pairs are joined
    frame = spark.createDataFrame([(k, t, "x", 1) for k, t in ODD], "doc_id long, text string, id string, n_a int")
    assert sorted(map(tuple, align_tokenizers(frame, *FILES).collect()), key=repr) == brute(ODD)
    assert align_tokenizers(frame.limit(0), *FILES).count() == 0


def test_repeated_rows_count(spark):
    one = align_tokenizers(spark.createDataFrame([(1, "some words here")], "doc_id long, text string"), *FILES).first()
    three = align_tokenizers(spark.createDataFrame([(1, "some words here")] * 3, "doc_id long, text string"), *FILES).collect()
    assert len(three) == 3 and {r.count_sum for r in three} == {3 * one.count_sum} and {r.n_best for r in three} == {one.n_best}


def in_this_process(table):
    """What tasks make of one batch: encoded rows, counted pairs and sums with no shared counts."""
    make_a, make_b = (lambda: ByteLevel(*FILES[:2])), (lambda: Pieces(FILES[2]))
    kinds, width = (np.uint16, np.uint16), len(make_b().bytes)
    encoded = pa.Table.from_batches(token_alignment._encode(make_a, make_b)(iter(table.to_batches())))
    numbered = encoded.append_column("row", pa.array(range(len(encoded)))).combine_chunks()
    counts = Counter()
    for part in token_alignment._count(kinds, width)(iter(numbered.to_batches())):
        counts.update(dict(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)))

    class Shared:
        value = (np.array(sorted(counts)[::2]), np.array([counts[k] for k in sorted(counts)[::2]]), np.ones(-(-len(counts) // 2), np.uint8))

    return encoded.to_pylist(), counts, pa.Table.from_batches(token_alignment._look_up(Shared, kinds, width)(iter(numbered.to_batches()))).to_pylist()


def test_small_slices_change_nothing(sf_dir, monkeypatch):
    table = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).slice(0, 60).combine_chunks()
    whole = in_this_process(table)
    monkeypatch.setattr(token_alignment, "SLICE_BYTES", 500)
    monkeypatch.setattr(token_alignment, "SLICE_LINKS", 300)
    monkeypatch.setattr(token_alignment, "GATHERED_PAIRS", 64)
    assert in_this_process(table) == whole


def test_both_libraries_agree():
    slow = Tokenizer.from_file(FILES[0])
    slow.encode_special_tokens = True
    texts = [f"x{chr(c)}x {chr(c)}1{chr(c)}{chr(c)} {chr(c)}'s" for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    assert ByteLevel(*FILES[:2]).encode(texts) == [e.ids for e in slow.encode_batch([" " + t for t in texts], add_special_tokens=False)]
