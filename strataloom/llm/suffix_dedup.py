"""Removing passages that occur elsewhere, with a distributed difference-cover suffix array.

A row per byte would shuffle some twenty times the text, so the array is sparse.  Its
sample are *cuts*: places where a hash of a few bytes is the least of its surroundings.
Like a difference cover they are hit by every window of ``length`` bytes, and equal
passages are sampled alike.

1. What all windows at a cut have in common is its core.  A core that occurs once has no
   repeated window and is discarded; cuts with equal surroundings are folded into one.
2. Cores are strings of phrases, from cut to cut.  Triples of phrases at two of three
   places are sorted and named, the strings of names are ranked in turn, and the
   remaining suffixes are merged in: that gives the order of the cores.
3. The windows at a cut are the suffixes that are not sampled.  They are ordered by their
   core's rank and the bytes on either side of it, and neighbours in that order are
   compared byte by byte.  Their common prefixes give the runs of windows that agree, and
   windows in one run are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataloom.llm.common import BROADCAST_BYTES, cut, join_small, mix, prefix_hashes, range_hashes, text_slices

#: Bytes that decide a cut, and grams within which there is one.  Windows have to be
#: longer than 3 * REACH + GRAM, so that they decide a whole phrase.
GRAM, REACH = 16, 96
#: Bytes of text at a time; the arrays over them take about a hundred times as much, and
#: those in use at once stay in a core's cache.
SLICE = 1 << 16
#: Suffixes, about, that a task merges.
MERGED = 100_000
#: A window's bytes beside its core, on both sides together.
BESIDE = REACH - 1


def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least or largest of x[i : i + width] for every i that has so many."""
    pick = np.minimum if least else np.maximum
    done = 1
    while done < width:
        step = min(done, width - done)
        x = pick(x[:-step], x[step:])
        done += step
    return x


def _grams(data: np.ndarray) -> np.ndarray:
    """A mixed number for the ``GRAM`` bytes from each place on, not 0."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    # eight bytes from each place on: a view by single bytes, copied
    eight = np.ndarray(len(data), "<u8", padded, 0, (1,)).copy()
    n = len(data) - GRAM + 1
    return (mix(mix(eight[:n] + np.uint64(0x2545F4914F6CDD1D)) + eight[8 : 8 + n]) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def cut_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places whose gram is the least of some full window of ``REACH`` grams of its text.

    Whether a place is a cut depends only on the bytes from REACH - 1 before it to
    REACH + GRAM - 1 after it, and every window has a cut.
    """
    n = len(data)
    if n < REACH + GRAM - 1:
        return np.zeros(0, np.int64)
    grams = _grams(data)
    least = _slide(grams, REACH, True)
    # windows that reach into the next text
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        least[max(begin, end - REACH - GRAM + 2) : end] = 0
    padded = np.zeros(len(grams) + REACH - 1, np.uint32)
    padded[REACH - 1 : REACH - 1 + len(least)] = least
    return np.flatnonzero(_slide(padded, REACH, False) == grams)


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int, int]]:
    """(first row, place of the bytes in it, bytes, offsets, first cut, last cut) for all texts.

    A text longer than ``SLICE`` comes in parts that overlap by what the windows of a cut
    need; the cuts from the first to before the last belong to the part.
    """
    margin = 4 * REACH + GRAM + length
    for row, data, offsets in text_slices(column, SLICE):
        if len(data) <= SLICE:
            yield row, 0, data, offsets, 0, len(data)
            continue
        for at in range(0, len(data), SLICE):
            low, high = max(at - margin, 0), min(at + SLICE + margin, len(data))
            yield row, low, data[low:high], np.array([0, high - low]), at - low, min(at + SLICE, len(data)) - low


class Phrases:
    """The cuts of some texts that have windows, in order, with the phrases after them.

    ``row`` and ``cut`` name a cut, ``low`` and ``high`` are its first and last window in
    the bytes and ``chain`` is the end of the phrases that all its windows decide.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, origin: int, since: int, until: int, length: int):
        self.prefix = prefix_hashes(data)
        self.data, self.length = data, length
        self.cuts = cuts = cut_points(data, offsets)
        row = np.searchsorted(offsets, cuts, "right") - 1
        first = np.diff(row, prepend=-1) != 0
        low = np.maximum(np.where(first, offsets[row], np.concatenate([[0], cuts])[: len(cuts)] - REACH + 2), offsets[row])
        high = np.minimum(cuts - REACH + 1, offsets[row + 1] - length)
        self.at = ok = np.flatnonzero((high >= low) & (cuts >= since) & (cuts < until))
        self.row, self.low, self.high, self.place = row[ok], low[ok], high[ok], cuts[ok]
        self.begin = offsets[self.row] - origin
        self.cut = self.place - self.begin
        # a window of this cut starts less than 2 * REACH before it
        self.chain = np.searchsorted(cuts, self.place + length - 3 * REACH - GRAM + 2, "right") - 1
        self.core = self.place - REACH + 1, self.place - 2 * REACH + 2 + length

    def cores(self) -> np.ndarray:
        """Hashes of the bytes that all windows which may belong to the cut have in common."""
        return range_hashes(self.prefix, *self.core)

    def covers(self) -> np.ndarray:
        """Hashes of all bytes that the cut's windows cover."""
        return range_hashes(self.prefix, self.low, self.high + self.length)

    def strings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the parts of the cores of some cuts, and where each cut's begin, with a final total.

        A core's parts are what is before the cut, its phrases, and what is left.
        """
        first, parts = self.at[which], self.chain[which] - self.at[which] + 2
        edges = np.concatenate([[0], np.cumsum(parts)])
        # the cut that ends each part, where it is not the last
        turn = np.arange(edges[-1]) - np.repeat(edges[:-1], parts)
        cuts = self.cuts[np.minimum(np.repeat(first, parts) + turn, len(self.cuts) - 1)]
        starts, ends = np.empty_like(cuts), cuts
        starts[1:] = cuts[:-1]
        starts[edges[:-1]], ends[edges[1:] - 1] = self.core[0][which], self.core[1][which]
        return range_hashes(self.prefix, starts, ends) >> np.uint64(1), edges


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, id, ver, text): ``id`` and ``ver`` tell different rows apart, whatever their keys."""
    return docs.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("id"), F.xxhash64(F.col(key), F.col(text)).alias("ver"), F.col(text).cast("string").alias("text"))


def _occurrences(source: DataFrame, length: int, fields: str) -> DataFrame:
    """A row per cut that has windows, with the ``fields`` asked for."""
    names = fields.split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, *piece in _pieces(batch.column(2), length):
                origin, data, offsets, since, until = piece
                p = Phrases(data, offsets, origin, since, until, length)
                at = pa.array(p.row + row)
                made: dict[str, Callable[[], pa.Array]] = {
                    "id": lambda: batch.column(0).take(at),
                    "ver": lambda: batch.column(1).take(at),
                    "cut": lambda: pa.array(p.cut),
                    "first": lambda: pa.array(p.low - p.begin),
                    "windows": lambda: pa.array((p.high - p.low + 1).astype(np.int32)),
                    "core": lambda: pa.array(p.cores().view(np.int64)),
                    "cover": lambda: pa.array(p.covers().view(np.int64)),
                }
                yield pa.record_batch([made[n]() for n in names], names)

    return source.select("id", "ver", "text").mapInArrow(run, ", ".join(f"{n} {'int' if n == 'windows' else 'long'}" for n in names))


# ---------------------------------------------------------------- the suffix array


def _names(keys: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The distinct ``keys`` with numbers in their order: a range sort, numbered by partition and place."""
    distinct = keys.select(*columns).distinct()
    return cut(distinct.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn(name, F.monotonically_increasing_id()))


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ranks one range of suffixes, which holds all that begin with its three symbols.

    Sampled suffixes are in order of their own ranks, the others in order of symbol and
    rank of the next suffix.  An unsampled suffix compares with a sampled one by that,
    or, when the sampled one's next is not sampled, by two symbols and a rank.
    """
    rows = pd.concat(list(batches), ignore_index=True)
    if not len(rows):
        return
    kind = rows["kind"].to_numpy()
    rest, ones, twos = (rows[kind == k] for k in range(3))
    rest = rest.sort_values(["s", "r1"])
    sampled = pd.concat([ones, twos]).sort_values("own")

    def below(columns: list[str], left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        """How many rows of ``right`` come before each row of ``left``."""
        both = pd.concat([left[columns].assign(_side=0), right[columns].assign(_side=1)]).reset_index(drop=True)
        ordered = both.sort_values([*columns, "_side"], kind="stable")
        before = ordered["_side"].cumsum().to_numpy()
        out = np.empty(len(both), np.int64)
        out[ordered.index.to_numpy()] = before
        return out[: len(left)]

    rank = pd.Series(0, index=rows.index, dtype="int64")
    rank[rest.index] = np.arange(len(rest)) + below(["s", "r1"], rest, ones) + below(["s", "s1", "r2"], rest, twos)
    place = pd.Series(np.arange(len(sampled)), index=sampled.index)
    place[ones.index] += below(["s", "r1"], ones, rest)
    place[twos.index] += below(["s", "s1", "r2"], twos, rest)
    rank[sampled.index] = place
    yield rows.assign(place=rank)


def suffix_ranks(strings: DataFrame, depth: int) -> DataFrame:
    """(sid, idx, rank) for every suffix of ``strings`` (sid, idx, s), idx counting from 0.

    ``s`` is not negative and no string is longer than ``depth``.  Ranks follow the order
    of the symbols, an end coming before any symbol, and equal suffixes at the same place
    of their strings share a rank.
    """
    own = Window.partitionBy("sid").orderBy("idx")
    ahead = lambda c, k: F.coalesce(F.when(F.lead("idx", k).over(own) == F.col("idx") + k, F.lead(c, k).over(own)), F.lit(-1))
    base = cut(strings.select("sid", "idx", "s", ahead("s", 1).alias("s1"), ahead("s", 2).alias("s2"), F.pmod("idx", F.lit(3)).alias("kind")))
    triple = ["s", "s1", "s2"]
    sampled = base.where("kind <> 0")
    names = _names(sampled, triple, "name")
    named = sampled.join(names, triple).select("sid", "idx", "name")
    if depth > 3:
        # both residues' names in one string, apart so that they do not touch
        far = 1 << 40
        inner = named.select("sid", (F.expr("idx div 3") + F.when(F.col("idx") % 3 == 2, F.lit(far)).otherwise(F.lit(0))).alias("idx"), F.col("name").alias("s"))
        found = suffix_ranks(inner, -(-depth // 3))
        place = F.when(F.col("idx") >= far, (F.col("idx") - far) * 3 + 2).otherwise(F.col("idx") * 3 + 1)
        named = found.select("sid", place.alias("idx"), F.col("rank").alias("name"))
    known = base.join(named, ["sid", "idx"], "left").withColumn("own", F.coalesce("name", F.lit(-1)))
    # a suffix keeps only what its comparisons read, so equal suffixes become one
    unless = lambda kind, c: F.when(F.col("kind") == kind, F.lit(-1)).otherwise(c)
    columns = ["kind", "s", "s1", "s2", "own", "r1", "r2"]
    known = cut(known.select("sid", "idx", "kind", *triple, unless(0, F.col("own")).alias("own"), unless(2, ahead("own", 1)).alias("r1"), unless(1, ahead("own", 2)).alias("r2")))
    # ranges by the first three symbols, so a frequent one alone does not fill a task
    parts = known.count() // MERGED + 1
    ranges = known.select(*columns).distinct().repartitionByRange(parts, *triple).withColumn("part", F.spark_partition_id())
    merged = cut(ranges.mapInPandas(_merge, "kind int, s long, s1 long, s2 long, own long, r1 long, r2 long, part int, place long"))
    merged = merged.select(*columns, (F.shiftleft(F.col("part").cast("long"), 40) + F.col("place")).alias("rank"))
    return known.join(merged, columns).select("sid", "idx", "rank")


# ---------------------------------------------------------------- windows in the array's order


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int((x != y).argmax())


class _Scan:
    """Runs of neighbours in sorted (rank, bytes) that agree on their first 0, 1, .. BESIDE bytes.

    ``start[d]`` is the place of the first member of the run at depth d.
    """

    def __init__(self, part: int):
        self.place = part << 40
        self.start = np.full(BESIDE + 1, -1, np.int64)
        self.last: tuple[int, bytes] | None = None

    def step(self, rank: int, beside: bytes) -> int:
        """Takes the next member and returns on how many bytes it agrees with the last, -1 for none."""
        agreed = -1 if self.last is None or self.last[0] != rank else _common(self.last[1], beside)
        self.start[agreed + 1 :] = self.place
        self.last = rank, beside
        self.place += 1
        return agreed


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted part: its first and last member, the starts of the last one's runs, and how far all agree."""
    scan, part, first, whole = None, 0, None, BESIDE
    for batch in batches:
        for p, rank, beside in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if scan is None:
                scan, part, first = _Scan(p), p, (rank, beside)
                scan.step(rank, beside)
            else:
                whole = min(whole, scan.step(rank, beside))
    if scan is not None:
        columns = [[part], [first[0]], [first[1]], [scan.last[0]], [scan.last[1]], [scan.start.tolist()], [min(whole, len(first[1]))]]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "rank", "beside", "last_rank", "last", "start", "whole"])


def _agreeing(sides: DataFrame, side: str) -> DataFrame:
    """(sid, runs): for each row of ``sides`` (sid, rank, ``side``) the runs it is in by depth.

    The rows are sorted by rank and bytes and neighbours are compared.  ``runs`` are
    (depth, run) with the depth from which on a run counts; two rows are in one run at
    a depth when they have equal ranks and agree on so many bytes.  A run that goes on
    over parts of the sort keeps its number: each part's two ends go through the driver,
    some kilobytes a part, however many rows there are.
    """
    ordered = sides.select("rank", F.col(side).alias("beside"), "sid").repartitionByRange("rank", "beside", "sid").sortWithinPartitions("rank", "beside")
    ordered = cut(ordered.select(F.spark_partition_id().alias("part"), "rank", "beside", "sid"))
    ends = ordered.mapInArrow(_ends, "part int, rank long, beside binary, last_rank long, last binary, start array<long>, whole int").collect()
    before: dict[int, tuple[int, bytes, np.ndarray]] = {}
    last = None
    for end in sorted(ends, key=lambda e: e["part"]):
        start = np.array(end["start"])
        if last is not None:
            before[end["part"]] = last
            agreed = _common(last[1], bytes(end["beside"])) if last[0] == end["rank"] else -1
            through = min(agreed, end["whole"])  # runs that hold the whole part and its forerunner
            start[: through + 1] = last[2][: through + 1]
        last = end["last_rank"], bytes(end["last"]), start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = None
        for batch in batches:
            sids, depths, runs, sizes = batch.column(3), [], [], [0]
            for p, rank, beside in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if scan is None:
                    scan = _Scan(p)
                    if p in before:
                        scan.last, scan.start = before[p][:2], before[p][2].copy()
                scan.step(rank, beside)
                own = scan.start[: len(beside) + 1]
                at = np.flatnonzero(np.diff(own, prepend=-2))
                depths.append(at)
                runs.append(own[at])
                sizes.append(len(at))
            if len(sizes) > 1:
                items = pa.StructArray.from_arrays([pa.array(np.concatenate(depths).astype(np.int32)), pa.array(np.concatenate(runs))], ["depth", "run"])
                yield pa.record_batch([sids, pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), items)], ["sid", "runs"])

    return ordered.mapInArrow(run, "sid long, runs array<struct<depth int, run long>>")


def _spells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each cut the spells of windows with one run on the left and one on the right.

    A window ``a`` bytes to the left of its core reaches BESIDE - a bytes to its right.
    """
    for batch in batches:
        rows = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
        out: list[tuple] = []
        for sid, n, low, high, lefts, rights in zip(*(rows[c] for c in ("sid", "n", "low", "high", "lefts", "rights")), strict=True):
            left, right = np.empty(high - low + 1, np.int64), np.empty(high - low + 1, np.int64)
            for r in lefts:
                left[max(r["depth"] - low, 0) :] = r["run"]
            for r in rights:
                right[: max(BESIDE - r["depth"] - low + 1, 0)] = r["run"]
            new = np.flatnonzero((np.diff(left, prepend=-2) != 0) | (np.diff(right, prepend=-2) != 0))
            ends = np.append(new[1:], len(left))
            out += zip([sid] * len(new), [n] * len(new), left[new].tolist(), right[new].tolist(), (new + low).tolist(), (ends + low).tolist(), strict=True)
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["sid", "n", "l", "r", "since", "until"])


def repeated_windows(strings: DataFrame) -> DataFrame:
    """(sid, since, until): spells of windows of ``strings`` that occur more than once.

    ``strings`` has the cuts: sid, how many there are (n), the rank of the core, the bytes
    to the left of the core (``lefts``, nearest first) and to the right, and the least and
    largest number of bytes that a window has on the left (low, high).
    """
    left = _agreeing(strings, "left").withColumnRenamed("runs", "lefts")
    right = _agreeing(strings, "right").withColumnRenamed("runs", "rights")
    both = strings.select("sid", "n", "low", "high").join(left, "sid").join(right, "sid").select("sid", "n", "low", "high", "lefts", "rights")
    spells = cut(both.mapInArrow(_spells, "sid long, n long, l long, r long, since int, until int"))
    # how many windows each run has at each depth, from where spells begin and end
    edge = lambda at, n: F.struct(F.col(at).alias("at"), n.alias("n"))
    edges = spells.select("l", "r", F.explode(F.array(edge("since", F.col("n")), edge("until", -F.col("n")))).alias("e"))
    edges = edges.select("l", "r", "e.*").groupBy("l", "r", "at").agg(F.sum("n").alias("n")).where("n <> 0")
    # a pair of runs has at most one edge per depth
    steps = edges.groupBy("l", "r").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("steps"))
    steps = steps.withColumn("total", F.expr("aggregate(steps, array(0L), (a, x) -> array_append(a, a[size(a) - 1] + x.n))"))
    several = F.expr("filter(transform(steps, (x, i) -> struct(x.at as low, steps[least(i + 1, size(steps) - 1)].at as high, total[i + 1] as n)), x -> x.n > 1)")
    several = steps.select("l", "r", several.alias("several")).where(F.size("several") > 0)
    met = spells.where("n = 1").join(several, ["l", "r"]).select("sid", "since", "until", F.explode("several").alias("x"))
    return met.select("sid", F.greatest("since", "x.low").alias("since"), F.least("until", "x.high").alias("until")).where("since < until")


# ---------------------------------------------------------------- the operator


def _candidates(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The cuts named in ``wanted`` (id, ver, cuts): id, ver, where the core begins, what is beside it and its phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, *piece in _pieces(batch.column(2), length):
                origin, data, offsets, since, until = piece
                p = Phrases(data, offsets, origin, since, until, length)
                lists = batch.column(3).slice(row, len(offsets) - 1)
                asked = np.repeat(np.arange(len(lists)), pa.compute.list_value_length(lists).to_numpy()) * _FAR + lists.flatten().to_numpy()
                hits = np.flatnonzero(np.isin(p.row * _FAR + p.cut, asked))
                begin, end = (x[hits] for x in p.core)
                raw = data.tobytes()
                left = [raw[a:b][::-1] for a, b in zip(p.low[hits].tolist(), begin.tolist(), strict=True)]
                right = [raw[a:b] for a, b in zip(end.tolist(), (p.high[hits] + length).tolist(), strict=True)]
                symbols, edges = p.strings(hits)
                at = pa.array(p.row[hits] + row)
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(p.cut[hits]), pa.array(begin - p.begin[hits]), pa.array((begin - p.high[hits]).astype(np.int32)), pa.array((begin - p.low[hits]).astype(np.int32)), pa.array(left, pa.binary()), pa.array(right, pa.binary()), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(symbols.view(np.int64)))]
                yield pa.record_batch(columns, ["id", "ver", "cut", "begin", "low", "high", "left", "right", "symbols"])

    # repeated rows with one key and text are one text here
    found = join_keys(docs, wanted, 8, "inner").select("id", "ver", "text", "cuts")
    found = found.mapInArrow(run, "id long, ver long, cut long, begin long, low int, high int, left binary, right binary, symbols array<long>")
    return found.dropDuplicates(["id", "ver", "cut"])


#: Texts are laid out so far apart that they do not touch.
_FAR = np.int64(1) << 40


def join_keys(docs: DataFrame, side: DataFrame, row_bytes: int, how: str) -> DataFrame:
    """Texts with what ``side`` has for their (id, ver) keys; it is cut, with a list in its last column."""
    size = side.agg(F.coalesce(F.sum(F.size(side.columns[-1]) * row_bytes + 64), F.lit(0))).first()[0]
    return docs.join(F.broadcast(side) if size <= BROADCAST_BYTES else side, ["id", "ver"], how)


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by half-open ranges sorted by start; ranges that touch are one run."""
    reach = np.maximum.accumulate(ends)
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return starts[new], reach[last]


def _runs(length: int):
    """Joins a text's neighbouring rows of windows, as far as they come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, starts, windows = (batch.column(i).to_numpy() for i in range(4))
            text = np.cumsum((np.diff(a, prepend=a[0]) != 0) | (np.diff(b, prepend=b[0]) != 0))
            order = np.lexsort((starts, text))
            first = starts[order] + text[order] * _FAR
            low, high = _merged(first, first + windows[order] - 1 + length)
            at = order[np.searchsorted(first, low)]
            yield pa.record_batch([pa.array(a[at]), pa.array(b[at]), pa.array(low % _FAR), pa.array(high - low + low % _FAR)], ["id", "ver", "low", "high"])

    return run


#: Texts that are put together at a time.
_ROWS = 256


def _strip(with_text: bool):
    """Removes the bytes in the ranges of the second column from the texts of the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                yield strip(batch.slice(at, _ROWS))

    def strip(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, removed, runs, sums, kept_texts = [], [], [], [], []
        for text, ranges in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            text = text or b""
            sizes.append(len(text))
            spans = sorted((r["low"], r["high"]) for r in ranges or ())
            if spans:
                low, high = _merged(*map(np.array, zip(*spans, strict=True)))
                runs.append(len(low))
                removed.append(int((high - low).sum()))
                edges = [0, *np.stack([low, high], 1).ravel().tolist(), len(text)]
                text = b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
            else:
                runs.append(0)
                removed.append(0)
            sums.append(hashlib.sha256(text).hexdigest())
            kept_texts.append(text if with_text else None)
        columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sums, pa.string()), pa.array(kept_texts, pa.binary())]
        return pa.record_batch(columns, ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400, with_text: bool = True) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, kept) for every document.

    Removed are all bytes that a string of ``length`` bytes covers which also starts
    anywhere else in the texts, the same text included; all copies go, the first too.
    Overlaps count, matches never cross documents, and texts are judged as they came in.
    ``kept`` holds the remaining bytes, which need not be whole characters; without
    ``with_text`` it is null.  A null text is empty; repeated rows are texts like any
    other, so they remove each other.  An empty table gives an empty result.  Keys are
    whole numbers and may be null; other columns play no part, whatever their names.
    """
    if length < 3 * REACH + GRAM:
        raise ValueError(f"the shortest repeat is {3 * REACH + GRAM} bytes")
    source = _keyed(docs, key, text)
    repeated = cut(_occurrences(source, length, "core").groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"))
    among = lambda fields: join_small(_occurrences(source, length, fields), repeated, "core", "left_semi", 16)
    classes = among("id ver cut core cover").groupBy("core", "cover").agg(F.count("*").alias("n"), F.min(F.struct("id", "ver", "cut")).alias("at"))
    classes = cut(classes)
    # cuts with equal cores but other surroundings: which of their windows agree is for the array to say
    mixed = classes.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1").select("core")
    edges = cut(classes.join(mixed, "core", "left_semi").select("at.*", "core", "n"))
    wanted = cut(edges.groupBy("id", "ver").agg(F.collect_set("cut").alias("cuts")))
    found = cut(_candidates(source, wanted, length).join(edges, ["id", "ver", "cut"]).withColumn("sid", F.monotonically_increasing_id()))
    # equal cores have equal phrases
    cores = cut(found.groupBy(F.col("core").alias("sid")).agg(F.first("symbols").alias("symbols")))
    depth = cores.agg(F.max(F.size("symbols"))).first()[0] or 1
    symbols = cores.select("sid", F.posexplode("symbols").alias("idx", "s")).select("sid", F.col("idx").cast("long").alias("idx"), "s")
    heads = cut(suffix_ranks(symbols, depth).where("idx = 0").select(F.col("sid").alias("core"), "rank"))
    strings = cut(join_small(found.select("sid", "core", "n", "low", "high", "left", "right"), heads, "core", "inner", 24))
    places = found.select("sid", "id", "ver", "begin")
    parts = repeated_windows(strings).join(places, "sid").select("id", "ver", (F.col("begin") - F.col("until") + 1).alias("first"), (F.col("until") - F.col("since")).alias("windows"))

    lone = cut(classes.where("n = 1").select("cover"))
    whole = join_small(among("id ver first windows core cover"), lone, "cover", "left_anti", 16).select("id", "ver", "first", "windows")
    ranges = whole.unionByName(parts).mapInArrow(_runs(length), "id long, ver long, low long, high long")
    ranges = cut(ranges.groupBy("id", "ver").agg(F.collect_list(F.struct("low", "high")).alias("ranges")))
    joined = join_keys(source, ranges, 24, "left").select("key", "text", "ranges")
    kind = docs.schema[key].dataType.simpleString()
    # what is small without the texts is computed here, in small batches
    out = joined.mapInArrow(_strip(with_text), f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return (out if with_text else cut(out)).withColumnRenamed("key", key)
