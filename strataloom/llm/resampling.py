"""Importance resampling of documents towards the distribution of target texts.

Runs of words are hashed into buckets.  How much more often a bucket occurs in the target
than in the documents is its gain; one array of gains scores every document.  Noise of
the key's hash turns the highest scores into a draw without replacement, and a
distributed quickselect finds the last one drawn.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataloom.llm.common import SLICE_BYTES, cut, small_batches, text_slices

BUCKETS = 10_000
#: Words in the longest run.
RUN = 3
#: Pivots that a round of the selection draws.
PIVOTS = 15
#: Drawn documents that one task ranks, about.
RANKED_ROWS = 200_000
#: Bytes of a word whose checksum is computed together with others'.
SHORT = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INK = np.zeros(256, bool)
_INK[48:58] = _INK[97:123] = _INK[128:] = True


def _crc_table() -> np.ndarray:
    """What the standard 32-bit checksum makes of each byte."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ np.uint32(0xEDB88320), out >> 1)
    return out


_CRC = _crc_table()


def _step(register: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return _CRC[(register ^ byte) & 255] ^ register >> 8


def _shift_tables() -> np.ndarray:
    """For 0 to SHORT zero bytes what they make of each byte of a register; such steps are linear."""
    byte = np.arange(256, dtype=np.uint32)
    out = [np.stack([byte << 8 * place for place in range(4)])]
    for _ in range(SHORT):
        out.append(_step(out[-1], 0))
    return np.stack(out)


_SHIFT = _shift_tables()


def _joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums of first + second from those of both and the second's length."""
    far = np.flatnonzero(length > SHORT)
    left = length[far] - SHORT
    near = np.minimum(length, SHORT)
    out = _shifted(first, near)
    while len(far):
        out[far] = _shifted(out[far], np.minimum(left, SHORT))
        left = left - SHORT
        far, left = far[left > 0], left[left > 0]
    return out ^ second


def _shifted(register: np.ndarray, length: np.ndarray) -> np.ndarray:
    out = _SHIFT[length, 0, register & 255]
    for place in range(1, 4):
        out = out ^ _SHIFT[length, place, register >> 8 * place & 255]
    return out


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(checksum, length, row) of all words of lower-cased ``data``; none crosses two rows."""
    ink = _INK[data]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before, after = np.concatenate([[False], ink[:-1]]), np.concatenate([ink[1:], [False]])
    before[inner] = False
    after[inner - 1] = False
    starts, ends = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
    length = ends - starts
    sums = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    active, at = np.flatnonzero(length <= SHORT), 0
    while len(active):
        sums[active] = _step(sums[active], data[starts[active] + at])
        at += 1
        active = active[length[active] > at]
    sums = ~sums
    for i in np.flatnonzero(length > SHORT).tolist():
        sums[i] = zlib.crc32(data[starts[i] : ends[i]])
    return sums, length, np.searchsorted(offsets, starts, "right") - 1


def _parts(data: np.ndarray) -> Iterator[np.ndarray]:
    """One long text in parts that end between words."""
    at = 0
    while at < len(data):
        end = min(at + SLICE_BYTES, len(data))
        while end < len(data) and _INK[data[end]] and _INK[data[end - 1]]:
            stops = np.flatnonzero(~_INK[data[end : end + SLICE_BYTES]])
            end = end + int(stops[0]) if len(stops) else min(end + SLICE_BYTES, len(data))
        yield data[at:end]
        at = end


def word_runs(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each word, bucket of each run, row of each run), a bounded slice of the texts at a time."""
    for first, data, offsets in text_slices(column):
        data = _LOWER[data]
        whole = len(offsets) > 2
        kept = 0  # of the words that the part before has counted, those that runs may begin with
        for part in [data] if whole else _parts(data):
            now = _words(part, offsets if whole else np.array([0, len(part)]))
            sums, length, row = now if not kept else (np.concatenate([a[-kept:], b]) for a, b in zip(last, now, strict=True))  # noqa: F821
            buckets, rows, run = [], [], sums
            for n in range(1, RUN + 1):
                if n > 1:
                    run = _joined(~_step(~run[:-1], 32), sums[n - 1 :], length[n - 1 :])
                own = row[: len(run)] == row[n - 1 :] if n <= len(row) else np.zeros(0, bool)
                own[: max(0, kept - n + 1)] = False
                buckets.append(run[own] % BUCKETS)
                rows.append(row[: len(run)][own] + first)
            yield row[kept:] + first, np.concatenate(buckets).astype(np.int64), np.concatenate(rows)
            last = (sums, length, row)
            kept = min(len(sums), RUN - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, buckets, _ in word_runs(batch.column(0)):
            counts += np.bincount(buckets, minlength=BUCKETS)
    full = np.flatnonzero(counts)
    yield pa.record_batch([pa.array(full), pa.array(counts[full])], ["bucket", "n"])


def bucket_counts(texts: DataFrame, text: str = "text") -> np.ndarray:
    """How many word runs of all ``texts`` fall into each bucket.

    Each task sends a row for each bucket at most, and so does their sum to the driver.
    """
    with small_batches(texts.sparkSession):
        found = texts.select(F.col(text).cast("string")).mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for row in found:
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(counts: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed share in the target over that in the documents."""
    s, t = int(counts.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    ratios = ((float(b) + 1) * s / ((float(a) + 1) * t) for a, b in zip(counts.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(x)) for x in ratios], np.int64)


def _weigh(gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words, features, weight = (np.zeros(n, np.int64) for _ in range(3))
            for own, buckets, rows in word_runs(batch.column(1)):
                words += np.bincount(own, minlength=n)
                features += np.bincount(rows, minlength=n)
                weight += np.bincount(rows, gains[buckets], n).astype(np.int64)  # sums of whole numbers far below 2**53 are exact
            yield pa.record_batch([batch.column(0), pa.array(words), pa.array(features), pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    return run


def _noise(key: str, seed: int) -> Column:
    """Thousandths of a Gumbel variable that the key's hash determines."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


_KEY = {"below": "long", "no_id": "boolean", "tie": "long", "row": "long"}


def _literal(key: Row | tuple) -> Column:
    return F.struct(*(F.lit(value).cast(kind).alias(name) for value, (name, kind) in zip(key, _KEY.items(), strict=True)))


def kth_key(keys: DataFrame, k: int, seed: int = 42) -> tuple:
    """The ``k``-th smallest ``key`` of cut ``keys``, no two of which are equal.

    A quickselect whose rows stay where they are.  Each round draws a few pivots at random
    from the keys that are still possible and counts exactly how many are below and at
    each; the keys between two pivots are left.  About one in ``PIVOTS`` stays a round.
    """
    inside, before, turn = keys, 0, 0
    while True:
        drawn = inside.orderBy(F.xxhash64("key.row", F.lit(seed), F.lit(turn)), "key").limit(PIVOTS).select("key.*").collect()
        pivots = sorted(tuple(row) for row in drawn)
        counts = inside.agg(*(F.count_if(F.col("key") < _literal(p)) for p in pivots), *(F.count_if(F.col("key") == _literal(p)) for p in pivots)).first()
        low = high = None
        left = before
        for pivot, below, equal in zip(pivots, counts[: len(pivots)], counts[len(pivots) :], strict=True):
            if before + below >= k:
                high = pivot
                break
            if before + below + equal >= k:
                return pivot
            low, left = pivot, before + below + equal
        if low is not None:
            inside = inside.where(F.col("key") > _literal(low))
        if high is not None:
            inside = inside.where(F.col("key") < _literal(high))
        before, turn = left, turn + 1


def _ranked(winners: DataFrame, n: int) -> DataFrame:
    """``winners`` with ``rank`` from 1 in the order of ``key``: sorted by ranges, whose sizes shift the ranks within."""
    ranges = cut(winners.repartitionByRange(-(-n // RANKED_ROWS), "key").withColumn("part", F.spark_partition_id()))
    shifts, total = {}, 0
    for part, size in sorted(map(tuple, ranges.groupBy("part").count().collect())):  # a row for each range
        shifts[part] = total
        total += size
    shift = F.create_map(*(F.lit(x) for pair in shifts.items() for x in pair))[F.col("part")]
    return ranges.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("key")) + shift).drop("part")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_features, weight, score, rank) of every document; rank is null unless it is drawn.

    Features are the runs of one to three words of the whole text, A-Z folded; ``weight``
    sums their buckets' gains, and ``score`` adds noise of the key's hash.  Of documents
    with ``least_words`` words, ``percent`` in 100 with the highest scores are drawn, ties
    to the smaller key, then, among rows with the same key, to the earlier one; a null key comes last.

    A null or empty text has no features and weight 0, and is never drawn if words are asked
    for.  Repeated rows count, and may be drawn, as often as they occur.  Empty documents
    give an empty result; with an empty target, gains are those of the smoothing.  A very
    long text is read in parts.  Other columns, of either table, play no part.  Keys are
    whole numbers.
    """
    gains = bucket_gains(bucket_counts(docs, text), bucket_counts(target, text))
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    weighed = source.mapInArrow(_weigh(gains), "id long, n_words long, n_features long, weight long")
    scored = cut(weighed.withColumn("score", F.col("weight") + _noise("id", seed)).withColumn("row", F.monotonically_increasing_id()))
    order = F.struct((-F.col("score")).alias("below"), F.col("id").isNull().alias("no_id"), F.coalesce("id", F.lit(0)).cast("long").alias("tie"), "row")
    fit = scored.where(F.col("n_words") >= least_words)
    draw = percent * fit.count() // 100
    out = [F.col("id").alias(key), "n_features", "weight", "score"]
    unranked = F.lit(None).cast("long").alias("rank")
    if not draw:
        return scored.select(*out, unranked)
    last = _literal(kth_key(fit.select(order.alias("key")), draw, seed))
    keyed = scored.withColumn("key", order)
    drawn = (F.col("n_words") >= least_words) & (F.col("key") <= last)
    ranked = _ranked(keyed.where(drawn), draw).select(*out, F.col("rank").cast("long").alias("rank"))
    return ranked.unionByName(keyed.where(~drawn).select(*out, unranked))
