"""What several operators share: lineage cuts, size-checked joins and word hashing.

The hashing helpers work on whole Arrow batches.  They read a text column's UTF-8
buffer as one numpy array, so no Python object is made per word, and they take
bounded slices of it, so memory does not follow the batch's size.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Largest table, in estimated bytes, that a join may send to every executor.
BROADCAST_BYTES = 24 << 20
#: Bytes of text that a task hashes at once.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IDENTITY = np.arange(256, dtype=np.uint8)
_ODD = 0x9E3779B97F4A7C15
#: Strings are hashed as polynomials modulo this prime at two points drawn at random, so
#: two different strings of n bytes agree with a probability of (n / 2**31)**2 at most.
_PRIME = (1 << 31) - 1
_random = np.random.Generator(np.random.PCG64(20240229))
_POINTS = [int(x) for x in _random.integers(1 << 24, _PRIME, 2)]
_BYTE_CODES = _random.integers(1, _PRIME, 256, dtype=np.uint64)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset, as in tests on one machine, a temporary folder takes its
    place.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return context.getCheckpointDir()


#: Rows that a Python worker is sent at once, where texts are long.
BATCH_ROWS = 1024
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Plans made within send their rows to Python in small batches, which bounds memory on both sides."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint(eager=True)


#: Rows of numbers that are worth a task.
TASK_ROWS = 1 << 16


def gathered(df: DataFrame) -> DataFrame:
    """``df`` cut, and read by as many tasks as its rows are worth, in whatever many parts a shuffle left them.

    Rows are counted while they are written.  For rows of a few hundred bytes at most.
    """
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-seen.get["n"] // TASK_ROWS))
    return out.coalesce(tasks) if out.rdd.getNumPartitions() >= 4 * tasks else out


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once, written as Parquet to the shared folder and read again; for loops that join what they have cut.

    A checkpoint keeps the size that Spark has estimated, which for a join is the product of both sides' sizes.  Over the
    rounds of a loop that number doubles its digits again and again, until it fills the driver's memory.  Files have a size.
    """
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_small(left: DataFrame, right: DataFrame, on: str, how: str, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join with ``right`` broadcast if its counted size is proven to be within ``limit``, else shuffled.

    ``right`` has to be cut, as it is counted here; ``row_bytes`` bounds one of its rows.
    """
    if right.count() * row_bytes <= limit:
        right = F.broadcast(right)
    return left.join(right, on, how)


#: Rows of one key from which on a join treats the key as hot.
HOT_ROWS = 1024


def join_sized(rows: DataFrame, side: DataFrame, key: str, row_bytes: int = 64, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Inner join with ``side``, one row a key with the number of its ``rows`` in ``size``.

    Hot keys are broadcast, so their rows stay where they are; the others are shuffled.
    Fewer than the sum of sizes over T keys have more than T rows, so the choice of T
    bounds the broadcast.  ``side`` has to be cut, as it is summed here.
    """
    total = side.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    least = max(HOT_ROWS, total * row_bytes // max(limit, 1))
    hot = F.broadcast(side.where(F.col("size") > least))
    cold = rows.join(hot.select(key), key, "left_anti").join(side.where(F.col("size") <= least), key)
    return rows.join(hot, key).unionByName(cold)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _fold(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers that equal those of ``x`` modulo the prime, below 2**33 if they are below 2**63."""
    high = x >> np.uint64(31)
    x = x & np.uint64(_PRIME)
    x += high
    return x


def _reduce(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers below 2**63 modulo the prime, by adding up their 31-bit digits."""
    x = _fold(_fold(x))
    # below the prime, subtracting it wraps round to a large number
    return np.minimum(x, x - np.uint64(_PRIME))


def _powers(point: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = _reduce(out[:step] * np.uint64(pow(point, done, _PRIME)))
        done += step
    return out.astype(np.uint32)


class Powers:
    """Powers of the hash points and of their inverses, grown on demand and kept per worker."""

    up = [_powers(x, 1) for x in _POINTS]
    down = [_powers(pow(x, -1, _PRIME), 1) for x in _POINTS]

    @classmethod
    def upto(cls, n: int) -> None:
        if len(cls.up[0]) < n:
            cls.up = [_powers(x, n) for x in _POINTS]
            cls.down = [_powers(pow(x, -1, _PRIME), n) for x in _POINTS]


def prefix_hashes(data: np.ndarray, fold: np.ndarray = _IDENTITY) -> list[np.ndarray]:
    """Sums for all ``data[:i]``, at both points, from which any range's hash follows; they are not reduced."""
    Powers.upto(len(data) + 1)
    codes = _BYTE_CODES[fold][data]
    out = []
    for up in Powers.up:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_fold(codes * up[: len(data)]), out=sums[1:])
        out.append(sums)
    return out


def _range_sums(prefix: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    return [_reduce(_reduce(h[ends] - h[starts]) * down[starts]) for h, down in zip(prefix, Powers.down, strict=True)]


def range_hashes(prefix: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ``data[start:end]``, independent of where the ranges lie."""
    first, second = _range_sums(prefix, starts, ends)
    return _finish(first, second, (ends - starts).astype(np.uint64))


def _finish(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix((first << np.uint64(31) | second) + length * np.uint64(_ODD))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets in the bytes) for runs of rows; nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of the rows, and each row's first word, with a final total.

    Words are runs without ASCII white space; none crosses two rows.
    """
    ink = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(ink)
    before[:1] = True
    np.logical_or(~ink[:-1], edge[1:-1], out=before[1:])
    starts = np.flatnonzero(ink & before)
    after = np.empty_like(ink)
    after[-1:] = True
    np.logical_or(~ink[1:], edge[1:-1], out=after[:-1])
    ends = np.flatnonzero(ink & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word (A-Z folded if ``lower``) and each row's first word."""
    starts, ends, first = words_of(data, offsets)
    return range_hashes(prefix_hashes(data, _LOWER if lower else _IDENTITY), starts, ends), first


def long_text_words(data: np.ndarray, lower: bool, limit: int = SLICE_BYTES) -> np.ndarray:
    """The word hashes of one text of any length, taken ``limit`` bytes at a time.

    A word that lies across pieces is put together from the sums of its parts.
    """
    fold = _LOWER if lower else _IDENTITY
    out: list[np.ndarray] = []
    sums, length = [0, 0], 0  # of a word that goes on in the next piece

    def close() -> None:
        nonlocal sums, length
        if length:
            out.append(_finish(*(np.array([x], np.uint64) for x in (*sums, length))))
        sums, length = [0, 0], 0

    for at in range(0, len(data), limit):
        piece = data[at : at + limit]
        starts, ends, _ = words_of(piece, np.array([0, len(piece)]))
        prefix = prefix_hashes(piece, fold)
        if length and (not len(starts) or starts[0] > 0):
            close()
        whole = np.ones(len(starts), bool)
        for i in ([0] if len(starts) and (length or ends[0] == len(piece)) else []) + ([len(starts) - 1] if len(starts) > 1 and ends[-1] == len(piece) else []):
            if i:
                close()
                out.append(range_hashes(prefix, starts[whole][:-1], ends[whole][:-1]))
                whole[:] = False
            shift, size = length, int(ends[i] - starts[i])
            parts = [int(x[0]) for x in _range_sums(prefix, starts[i : i + 1], ends[i : i + 1])]
            sums = [(s + pow(x, shift, _PRIME) * p) % _PRIME for s, x, p in zip(sums, _POINTS, parts, strict=True)]
            length += size
            whole[i] = False
            if ends[i] < len(piece):
                close()
        out.append(range_hashes(prefix, starts[whole], ends[whole]))
    close()
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def text_words(column: pa.Array, lower: bool) -> Iterator[np.ndarray]:
    """The word hashes of each text of a column, in order."""
    for _, data, offsets in text_slices(column):
        if len(offsets) == 2:
            yield long_text_words(data, lower)
            continue
        hashes, first = word_hashes(data, offsets, lower)
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield hashes[a:b]


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` words; fewer words make one window, none make none."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix(out + words[k : k + n]) * np.uint64(_ODD)
    return mix(out)
