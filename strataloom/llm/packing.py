"""Best-fit packing of documents into training sequences, with certified bin counts."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import cut

# ---------------------------------------------------------------- tokens

#: Words whose ids a worker remembers.
REMEMBERED = 300_000
#: Characters of texts that are split at once, and new words that are encoded at once.
SLICE, LEARNED = 1 << 19, 512
#: Texts of these characters read alike in all Unicode versions in use and are in
#: normal form; others, and those that spell a special token, go to the tokenizer whole.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\u00a0-\u017f]*\Z")
_SPACE = re.compile(r"\s")
_LETTER = "a-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
_DIGIT = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
#: The tokenizer file's own split, for plain texts after lower-casing, takes short forms,
#: runs of letters, single digits and runs of what else is not white space.
_SHORT = ("s", "t", "re", "ve", "m", "ll", "d")
SPACE, LETTER, DIGIT, OTHER = range(4)
_KINDS = np.full(0x400, OTHER, np.uint8)
for _kind, _class in ((SPACE, r"\s"), (LETTER, _LETTER), (DIGIT, _DIGIT)):
    _KINDS[[c for c in range(len(_KINDS)) if re.match(f"[{_class}]", chr(c))]] = _kind


def word_bounds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in the code points of plain texts in lower case."""
    # a space before and some behind, so that every place has neighbours; places count from 1
    kinds, codes = np.pad(_KINDS[codes], (1, 4)), np.pad(codes, (1, 4))
    start = np.zeros(len(kinds), bool)
    start[1:] = (kinds[1:] != SPACE) & ((kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT))
    # an apostrophe that begins a run of other characters takes the letters of a short form
    marks = np.flatnonzero(start & (codes == ord("'")))
    for letters in _SHORT:
        at = marks[np.logical_and.reduce([codes[marks + 1 + k] == ord(c) for k, c in enumerate(letters)])]
        start[at + 1] = False
        after = at + 1 + len(letters)
        start[after[kinds[after] == LETTER]] = True
    end = (kinds[:-1] != SPACE) & (start[1:] | (kinds[1:] == SPACE))
    return np.flatnonzero(start) - 1, np.flatnonzero(end)


def text_runs(texts: dict[int, str]) -> Iterator[tuple[list[int], list[int], str]]:
    """(keys, places, text): texts put together, a space between, up to about ``SLICE`` characters.

    A longer text comes in parts of its own, each up to a white space, so no word is parted.
    """
    keys, places, some, size = [], [], [], 0
    for key, text in texts.items():
        if len(text) > SLICE:
            at = 0
            while at < len(text):
                space = _SPACE.search(text, at + SLICE)
                end = space.start() if space else len(text)
                yield [key], [0], text[at:end]
                at = end
            continue
        if size + len(text) > SLICE:
            yield keys, places, " ".join(some)
            keys, places, some, size = [], [], [], 0
        keys.append(key)
        places.append(size)
        some.append(text)
        size += len(text) + 1
    if keys:
        yield keys, places, " ".join(some)


class WordEncoder:
    """Ids of whole texts under a BPE file with word ends, remembering words.

    The file's tokenizer splits a normalised text into words and encodes each alone, so
    a text's ids are its words' ids in turn.  Many texts are split at once as arrays, and
    each of their distinct words is looked up once.  New words are encoded together, by
    the file's model alone, as they are split and normalised; the ids whose token ends a
    word tell them apart.  ``ids`` has the ids of all words remembered, from ``first`` on.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.first = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        ids, ends = [self.ids], [self.first]
        for at in range(0, len(words), LEARNED):
            some = words[at : at + LEARNED]
            ids.append(np.array(self.words.encode(" ".join(some), add_special_tokens=False).ids, "<u4"))
            stops = np.flatnonzero(self.ends[ids[-1]]) + 1
            if len(stops) != len(some):
                raise ValueError("this tokenizer does not mark the ends of words")
            ends.append(stops + ends[-1][-1])
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.ids, self.first = np.concatenate(ids), np.concatenate(ends)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The places of distinct words in what is remembered."""
        numbers = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(numbers < 0)
        if len(self.known) + len(missing) > REMEMBERED:
            self._forget()
            missing = np.arange(len(words))
        if len(missing):
            numbers[missing] = len(self.known) + np.arange(len(missing))
            self._learn([words[i] for i in missing.tolist()])
        return numbers

    def _split(self, places: list[int], text: str) -> list[bytes]:
        """The ids of the texts that begin at ``places`` of a plain text in lower case."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts, ends = word_bounds(codes)
        if not len(starts):
            return [b""] * len(places)
        # the words without what is between them, as one Arrow column
        letters = codes[_KINDS[codes] != SPACE]
        firsts = np.cumsum(ends - starts) - (ends - starts)
        sizes = np.add.reduceat(1 + (letters >= 0x80).astype(np.int32), firsts)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters.tobytes().decode("utf-32-le").encode())).dictionary_encode()
        which = self._numbers(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()]
        # the remembered ids, taken word by word
        first, each = self.first[which], self.first[which + 1] - self.first[which]
        until = np.concatenate([[0], np.cumsum(each)])
        ids = self.ids[np.repeat(first - until[:-1], each) + np.arange(until[-1])]
        edges = [*until[np.searchsorted(starts, places)].tolist(), len(ids)]
        return [ids[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out, plain = [b""] * len(texts), {}
        for row, text in enumerate(texts):
            if not _PLAIN.match(text) or any(s in text for s in self.special):
                out[row] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                plain[row] = text.lower()
        for rows, places, text in text_runs(plain):
            for row, ids in zip(rows, self._split(places, text), strict=True):
                out[row] += ids
        return out


@lru_cache(maxsize=1)
def _encoder(path: str, changed: int) -> WordEncoder:
    """A worker's encoder, kept from task to task while the file is unchanged."""
    return WordEncoder(path)


def pieces(docs: DataFrame, tokenizer_path: str, length: int, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32): each document's ids and ``end_id``, cut every ``length``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path, os.stat(tokenizer_path).st_mtime_ns)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, numbers, sizes, sums = [], [], [], []
            for row, ids in enumerate(encoder.encode(batch.column(1).fill_null("").to_pylist())):
                ids += end
                for number, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append(row)
                    numbers.append(number)
                    sizes.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
            number = np.array(numbers, np.int32)
            yield pa.record_batch(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(number), pa.array(number.astype(np.int64) * length), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())],
                ["id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- bins


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by dual feasible functions of the sizes.

    Beside the identity: for a threshold t, items over capacity - t count as whole bins,
    those under t as nothing and the others as they are; and for a number k, sizes
    rounded to multiples of 1 / k, multiples of it kept.  Sizes are at most ``capacity``.
    """
    values, counts = np.unique(sizes, return_counts=True)
    best = ceil(int((values * counts).sum()) / capacity)
    for t in {int(v) for v in values if 2 * v <= capacity}:
        worth = np.where(values > capacity - t, capacity, np.where(values < t, 0, values))
        best = max(best, ceil(int((worth * counts).sum()) / capacity))
    for k in range(1, 21):
        over = values * (k + 1)
        worth = np.where(over % capacity == 0, values * k, over // capacity * capacity)
        best = max(best, ceil(int((worth * counts).sum()) / (capacity * k)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, longest first, each into the fullest bin that holds it.

    Open bins are kept by their free space; the bits of a number mark the spaces in use.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, n = 0, 0
    for item in order.tolist():
        size = int(sizes[item])
        above = used >> size
        if above:
            space = size + (above & -above).bit_length() - 1
            home = free[space].pop()
            if not free[space]:
                used &= ~(1 << space)
        else:
            space, home, n = capacity, n, n + 1
        bins[item], offsets[item] = home, capacity - space
        if space > size:
            free[space - size].append(home)
            used |= 1 << (space - size)
    return bins, offsets


def _pack_group(capacity: int, last: bool):
    """Packs one group and marks the pieces to exchange in ``open``.

    A group whose bins number its lower bound is certified and gives up only bins under
    half full.  One with a gap gives up its emptiest bins, up to half its pieces.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "row"], ascending=[False, True]).reset_index(drop=True)
        sizes = rows["length"].to_numpy()
        bins, offsets = best_fit_decreasing(sizes, capacity)
        filled = np.bincount(bins, weights=sizes).astype(np.int64)
        bound = lower_bound(sizes, capacity)
        if last:
            gives = np.zeros(len(filled), bool)
        elif len(filled) == bound:
            gives = 2 * filled < capacity
        else:
            emptiest = np.argsort(filled, kind="stable")
            gives = np.zeros(len(filled), bool)
            gives[emptiest[2 * np.cumsum(np.bincount(bins)[emptiest]) <= len(sizes)]] = True
            gives &= filled < capacity
        first = np.empty(len(filled), np.int64)
        first[bins[offsets == 0]] = rows["row"].to_numpy()[offsets == 0]
        return rows.drop(columns="group").assign(sequence_id=first[bins], offset=offsets, group_bins=len(filled), group_bound=bound, open=gives[bins])

    return run


def pack(parts: DataFrame, capacity: int = 2048, group_rows: int = 20_000) -> DataFrame:
    """``parts`` (id, piece, start, length, ids_crc32) with sequence_id, offset and a certificate.

    Whole pieces are sequences of their own.  The others are dealt at random into groups
    of about ``group_rows``, and each group is packed best fit decreasing and compared
    with its lower bound.  The pieces that groups give up are exchanged: dealt into
    fewer groups and packed again, until one group has packed all that is left.
    ``group_bins`` and ``group_bound`` are those of the group that packed the piece.
    A sequence's number is its first piece's row number.
    """
    parts = cut(parts.withColumn("row", F.monotonically_increasing_id()))
    one = F.lit(1).cast("long")
    whole = parts.where(F.col("length") >= capacity).select("*", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), one.alias("group_bins"), one.alias("group_bound"))
    rest = parts.where(F.col("length") < capacity)
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.schema) + ", open boolean"
    out, turn = whole, 0
    while n := rest.count():
        groups = ceil(n / group_rows)
        dealt = rest.withColumn("group", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(groups)))
        packed = cut(dealt.groupBy("group").applyInPandas(_pack_group(capacity, groups == 1), shape))
        out = out.unionByName(packed.where("not open").drop("open"))
        rest = packed.where("open").select(*parts.columns)
        turn += 1
    return out.drop("row")


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text", group_rows: int = 20_000
) -> DataFrame:
    """Every piece of every document with its place in a sequence.

    A null or empty text is ``end_id`` alone.  Repeated rows are packed as often as they
    occur; an empty table gives an empty result; other columns play no part.
    """
    packed = pack(pieces(docs, tokenizer_path, capacity, end_id, key, text), capacity, group_rows)
    return packed.withColumnRenamed("id", key)
