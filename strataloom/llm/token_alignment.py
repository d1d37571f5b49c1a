"""Alignment of two tokenizers' tokens on the bytes of each text.

Both token sequences cover the same bytes.  In each batch, keyed by document, every
token's start finds the other side's token that covers it; the union of both directions
holds each overlap once, in the order of the bytes, and offsets where tokens of both sides
end cut a document into groups.  Pairs of ids are counted over all documents, and the
counts come back to each document's overlaps.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import cut, shared_folder, small_batches

#: Bytes of text that are aligned at once; a longer text is aligned alone.
SLICE_BYTES = 1 << 20
#: Overlaps that are counted or looked up at once.
SLICE_LINKS = 1 << 21
#: Most pairs of ids whose counts go to every executor, 17 bytes each.
SHARED_PAIRS = 1 << 22
#: Pairs of ids whose counts a task gathers before it hands them on.
GATHERED_PAIRS = 1 << 22


class ByteLevel:
    """Ids and token bytes of a byte-level BPE file.

    The file's ids are in the order of its merges, so tiktoken, given its tokens as ranks,
    finds the same ids several times faster than the file's own library, which takes
    over where tiktoken gives up on a text.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [byte for byte in range(256) if byte not in plain]
        letters = {chr(byte): byte for byte in plain} | {chr(256 + i): byte for i, byte in enumerate(others)}
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        special = {token["content"] for token in stored["added_tokens"]}
        vocab = {token: i for token, i in stored["model"]["vocab"].items() if token not in special}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items()}
        self.path = path
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.quick = tiktoken.Encoding(base64.b64encode(path.encode()).decode(), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._one(" " + text) for text in texts]

    def _one(self, text: str) -> list[int]:
        try:
            return self.quick.encode_ordinary(text)
        except BaseException as error:  # the library panics, with no Exception, where its splitter runs out of steps
            if isinstance(error, (KeyboardInterrupt, SystemExit)):
                raise
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(self.path)
            slow.encode_special_tokens = True
            return slow.encode(text, add_special_tokens=False).ids


class Pieces:
    """Ids and piece bytes of a sentencepiece model that puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        self.bytes = [bytes([int(self.model.id_to_piece(i)[1:-1], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode() for i in ids]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


class _Side:
    """One tokenizer's tokens of a slice of documents, laid end to end."""

    def __init__(self, encoder: ByteLevel | Pieces):
        self.encoder = encoder
        self.kind = np.uint16 if len(encoder.bytes) <= 1 << 16 else np.uint32
        self.length = np.array([len(x) for x in encoder.bytes], np.int64)
        places = len(str(len(encoder.bytes)))
        ids = np.arange(len(encoder.bytes))
        self.digits = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, places))
        self.signs = np.stack([ids // 10 ** np.maximum(self.digits - 1 - k, 0) % 10 + 48 for k in range(places)], 1).astype(np.uint8)

    def read(self, lists: list[list[int]]) -> None:
        self.counts = np.array([len(x) for x in lists], np.int64)
        self.ids = np.concatenate([np.array(x, np.int64) for x in lists]) if lists else np.zeros(0, np.int64)
        self.doc = np.repeat(np.arange(len(lists)), self.counts)
        length = self.length[self.ids]
        self.start = np.cumsum(length) - length

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({"at": self.start, "doc": self.doc, "token": np.arange(len(self.ids))})


def align(a: _Side, b: _Side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token of a, token of b, steps) for all overlaps in the order of the bytes.

    Bit 0 of a step tells that the overlap begins with its token of a, bit 1 the same of b.
    Documents lie end to end, and each begins with a token of both.
    """
    left, right = a.frame(), b.frame()
    over = pd.merge_asof(left, right, on="at", by="doc", suffixes=("", "_other"))
    under = pd.merge_asof(right, left, on="at", by="doc", suffixes=("", "_other"))
    inner = a.start[under["token_other"].to_numpy(np.int64)] < under["at"].to_numpy()  # equal starts are in the other direction
    at = np.concatenate([over["at"].to_numpy(), under["at"].to_numpy()[inner]])
    order = np.argsort(at, kind="stable")
    i = np.concatenate([over["token"].to_numpy(), under["token_other"].to_numpy()[inner]]).astype(np.int64)[order]
    j = np.concatenate([over["token_other"].to_numpy(), under["token"].to_numpy()[inner]]).astype(np.int64)[order]
    at = at[order]
    return i, j, ((a.start[i] == at) + 2 * (b.start[j] == at)).astype(np.uint8)


def _spelled(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups of all documents as decimal ids, a sign after each id, and where each document's begin."""
    group = np.cumsum(steps == 3) - 1
    groups = int(group[-1]) + 1 if len(group) else 0
    own_a, own_b = group[(steps & 1) > 0], group[(steps & 2) > 0]  # of the tokens in turn
    n_a, n_b = np.bincount(own_a, minlength=groups), np.bincount(own_b, minlength=groups)
    place_a = np.arange(len(a.ids)) + (np.cumsum(n_b) - n_b)[own_a]
    place_b = np.arange(len(b.ids)) + np.cumsum(n_a)[own_b]
    n = len(a.ids) + len(b.ids)
    digits, signs = np.empty(n, np.int64), np.empty((n, max(a.signs.shape[1], b.signs.shape[1])), np.uint8)
    after = np.full(n, ord(","), np.uint8)
    for side, place in ((a, place_a), (b, place_b)):
        digits[place] = side.digits[side.ids]
        signs[place, : side.signs.shape[1]] = side.signs[side.ids]
    last = np.cumsum(n_a + n_b) - 1
    after[last - n_b] = ord("|")
    after[last] = ord(";")
    ends = np.cumsum(digits + 1)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    begin = ends - digits - 1
    for k in range(signs.shape[1]):
        some = np.flatnonzero(digits > k)
        out[begin[some] + k] = signs[some, k]
    out[ends - 1] = after
    tokens = np.cumsum(a.counts + b.counts)
    return out, np.concatenate([[0], ends])[np.concatenate([[0], tokens])]


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for row, text in enumerate(texts):
        if size and size + len(text or "") > SLICE_BYTES:
            yield start, row
            start, size = row, 0
        size += len(text or "")
    if start < len(texts):
        yield start, len(texts)


_ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a binary, b binary, steps binary"


def _encode(make_a, make_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = a, b = _Side(make_a()), _Side(make_b())
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, stop in _slices(texts):
                some = [text or "" for text in texts[first:stop]]
                found = [side.encoder.encode(some) for side in sides]
                for row, text in enumerate(some):
                    want = b" " + text.encode()
                    if not text or any(b"".join([side.encoder.bytes[x] for x in ids[row]]) != want for side, ids in zip(sides, found, strict=True)):
                        found[0][row] = found[1][row] = []
                for side, ids in zip(sides, found, strict=True):
                    side.read(ids)
                i, j, steps = align(a, b)
                spelled, bounds = _spelled(a, b, i, j, steps)
                links = np.concatenate([[0], np.cumsum(np.bincount(a.doc[i], minlength=len(some)))])
                shared = np.concatenate([[0], np.cumsum(steps == 3)])[links]
                out: dict[str, list] = {name.split()[0]: [] for name in _ALIGNED.split(", ")}
                at_a, at_b = (np.concatenate([[0], np.cumsum(side.counts)]) for side in sides)
                for row in range(len(some)):
                    part = spelled[bounds[row] : bounds[row + 1] - 1]
                    out["groups_sha256"].append(hashlib.sha256(part).hexdigest() if a.counts[row] else "")
                    out["a"].append(a.ids[at_a[row] : at_a[row + 1]].astype(a.kind).tobytes())
                    out["b"].append(b.ids[at_b[row] : at_b[row + 1]].astype(b.kind).tobytes())
                    own = steps[links[row] : links[row + 1]]
                    out["steps"].append(np.packbits(np.stack([own & 1, own >> 1], 1).ravel()).tobytes())
                out |= {"n_a": a.counts, "n_b": b.counts, "n_groups": np.diff(shared), "n_links": np.diff(links)}
                yield pa.record_batch([batch.column(0).slice(first, stop - first), *(pa.array(x) for x in out.values())], ["id", *out])

    return run


def _joined(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _pairs(batch: pa.RecordBatch, kinds: tuple[type, type], width: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, row after the last, id pairs of all their overlaps); a pair is id of a * ``width`` + id of b."""
    columns = dict(zip(batch.schema.names, batch.columns, strict=True))
    sizes = columns["n_links"].to_numpy()
    start = total = 0
    stops = []
    for row, size in enumerate(sizes.tolist()):
        if total and total + size > SLICE_LINKS:
            stops.append(row)
            total = 0
        total += size
    for stop in [*stops, batch.num_rows]:
        part = slice(start, stop - start)
        a, b = (_joined(columns[name].slice(part.start, part.stop), kind) for name, kind in zip("ab", kinds, strict=True))
        bits = [np.unpackbits(np.frombuffer(x, np.uint8), count=2 * n) for x, n in zip(columns["steps"].slice(part.start, part.stop).to_pylist(), sizes[start:stop].tolist(), strict=True)]
        steps = np.concatenate([*bits, np.zeros(0, np.uint8)]).reshape(-1, 2)
        # every document begins with a token of both sides, so counting goes on across documents
        yield start, stop, a[np.cumsum(steps[:, 0], dtype=np.int64) - 1].astype(np.int64) * width + b[np.cumsum(steps[:, 1], dtype=np.int64) - 1]
        start = stop


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    pairs, places = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
    return [(pairs, np.bincount(places, np.concatenate([n for _, n in found]), len(pairs)).astype(np.int64))]


def _count(kinds: tuple[type, type], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        gathered = held = 0  # pairs in all parts, and in the first, which is merged
        for batch in batches:
            for _, _, pairs in _pairs(batch, kinds, width):
                found.append(np.unique(pairs, return_counts=True))
                gathered += len(found[-1][0])
                if gathered > max(GATHERED_PAIRS // 4, 2 * held):
                    found = _merged(found)
                    gathered = held = len(found[0][0])
                if held > GATHERED_PAIRS:
                    yield pa.record_batch([pa.array(x) for x in found[0]], ["pair", "n"])
                    found, gathered, held = [], 0, 0
        if found:
            yield pa.record_batch([pa.array(x) for x in _merged(found)[0]], ["pair", "n"])

    return run


def _pack(rows: pa.Table) -> pa.Table:
    columns = [rows.column("pair").to_numpy().tobytes(), rows.column("n").to_numpy().tobytes(), np.packbits(rows.column("best").to_numpy(zero_copy_only=False)).tobytes()]
    return pa.table([pa.array([x], pa.binary()) for x in columns], ["pair", "n", "best"])


def _shared(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending pairs with counts and marks; there are at most ``SHARED_PAIRS``."""
    part = F.pmod(F.xxhash64("pair"), F.lit(64))
    parts = counts.groupBy(part).applyInArrow(_pack, "pair binary, n binary, best binary").collect()
    pair, n = (np.concatenate([np.frombuffer(row[name], np.int64) for row in parts] + [np.zeros(0, np.int64)]) for name in ("pair", "n"))
    best = np.concatenate([np.unpackbits(np.frombuffer(row["best"], np.uint8), count=len(row["pair"]) // 8) for row in parts] + [np.zeros(0, np.uint8)])
    order = np.argsort(pair)
    return pair[order], n[order], best[order]


_COUNTED = "id {kind}, row long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, rest array<struct<pair:long,times:long>>"


def _look_up(shared, kinds: tuple[type, type], width: int):
    """Sums over each document's overlaps, and the pairs that are not in ``shared`` with their number in it."""
    rest_type = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            for first, stop, links in _pairs(batch, kinds, width):
                distinct, places = np.unique(links, return_inverse=True)
                at = np.minimum(np.searchsorted(pair, distinct), max(len(pair) - 1, 0))
                known = pair[at] == distinct if len(pair) else np.zeros(len(distinct), bool)
                bounds = np.concatenate([[0], np.cumsum(columns["n_links"].slice(first, stop - first).to_numpy())])
                sums = []
                for worth in (best, n):
                    each = np.where(known, worth[at], 0).astype(np.int64) if len(pair) else np.zeros(len(distinct), np.int64)
                    sums.append(np.diff(np.concatenate([[0], np.cumsum(each[places])])[bounds]))
                missed = np.flatnonzero(~known[places])
                row = np.searchsorted(bounds, missed, "right") - 1
                keys, times = np.unique(np.stack([row, places[missed]]), axis=1, return_counts=True) if len(missed) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
                rests = pa.StructArray.from_arrays([pa.array(distinct[keys[1]]), pa.array(times.astype(np.int64))], ["pair", "times"])
                offsets = np.searchsorted(keys[0], np.arange(stop - first + 1)).astype(np.int32)
                kept = [columns[name].slice(first, stop - first) for name in ("id", "row", "n_a", "n_b", "n_groups", "n_links")]
                arrays = [*kept, *(pa.array(x) for x in sums), columns["groups_sha256"].slice(first, stop - first), pa.ListArray.from_arrays(pa.array(offsets), rests, rest_type)]
                yield pa.record_batch(arrays, ["id", "row", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "rest"])

    return run


def token_overlaps(docs: DataFrame, make_a, make_b, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's tokens of both sides and their alignment, written to the shared folder.

    ``make_a`` and ``make_b`` make the encoders, in each task.  ``a`` and ``b`` hold ids
    as unsigned numbers, ``steps`` two bits an overlap in the order of the bytes: whether
    it begins with its token of a, of b.
    """
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/overlaps-{uuid.uuid4().hex}"
    source = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    with small_batches(spark):
        found = source.mapInArrow(_encode(make_a, make_b), f"id {kind}, {_ALIGNED}")
        found.withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def align_tokenizers(docs: DataFrame, byte_bpe: str, pattern: str, pieces: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every document.

    a is the byte-level BPE file at ``byte_bpe``, which splits texts by ``pattern``, over a
    space and the text; b the sentencepiece model at ``pieces``.  Overlaps are all pairs of
    an a and a b token that share bytes; a pair of ids counts as often as documents hold
    it, repeated rows included.  ``n_best`` are the overlaps whose count is the highest of
    their b id, ties included, and ``count_sum`` sums the counts over all overlaps.

    Null and empty texts, and those whose tokens do not spell a space and the text, have
    no tokens: zeros and an empty string.  A null key keeps its row.  An empty table gives
    an empty result; other columns play no part.  A task holds the tokens of ``SLICE_BYTES``
    of text or, beyond, of one text.

    Counts of up to ``SHARED_PAIRS`` pairs go to every executor; of more pairs those that
    are frequent go there, and the overlaps of the others are shuffled to their counts.
    """
    spark = docs.sparkSession
    make_a, make_b = (lambda: ByteLevel(byte_bpe, pattern)), (lambda: Pieces(pieces))
    a, b = make_a(), make_b()
    kinds, width = (_Side(a).kind, _Side(b).kind), len(b.bytes)
    overlaps = token_overlaps(docs, make_a, make_b, key, text)
    linked = overlaps.where("n_links > 0")
    with small_batches(spark):
        counts = cut(linked.select("n_links", "a", "b", "steps").mapInArrow(_count(kinds, width), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    b_id = F.pmod("pair", F.lit(width))
    highest = counts.groupBy(b_id.alias("b_id")).agg(F.max("n").alias("highest"))  # a row for each id of b at most
    marked = cut(counts.join(F.broadcast(highest), b_id == F.col("b_id")).select("pair", "n", (F.col("n") == F.col("highest")).alias("best")))
    size, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequent = 0 if size <= SHARED_PAIRS else total // SHARED_PAIRS  # fewer than SHARED_PAIRS pairs have more
    shared = spark.sparkContext.broadcast(_shared(marked.where(F.col("n") > frequent)))
    schema = _COUNTED.format(kind=docs.schema[key].dataType.simpleString())
    sums = cut(overlaps.mapInArrow(_look_up(shared, kinds, width), schema))
    if frequent:
        rest = sums.select("row", F.explode("rest").alias("x")).select("row", "x.*").join(marked.where(F.col("n") <= frequent), "pair")
        more = rest.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
        sums = sums.join(more, "row", "left")
        add = lambda name, other: (F.col(name) + F.coalesce(other, F.lit(0))).alias(name)
        sums = sums.select("id", "n_a", "n_b", "n_groups", "n_links", add("n_best", "more_best"), add("count_sum", "more_sum"), "groups_sha256")
    return sums.select(F.col("id").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
