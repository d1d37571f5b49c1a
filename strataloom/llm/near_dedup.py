"""MinHash near-duplicate classes.

One-permutation hashing with optimal densification gives each text a signature; bands of
it make buckets; in each bucket stars of candidate links go out from the best connected
members, and full shingle sets confirm every link.  Members that the stars leave apart,
though they share a bucket, go into finer buckets, one for each of their rarest
shingles, of which two near texts share at least one; there the stars grow until all
members are compared or connected.  Connected components of the links are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataloom.llm.common import HOT_ROWS, cut, gathered, mix, shingle_hashes, stored, text_words
from strataloom.llm.common import join_sized as _join_sized
from strataloom.llm.common import join_small as _join_small

BINS = 256
#: Signature values in a band, and bands.  Two texts of similarity s miss every bucket
#: with probability (1 - s**5)**51: one in a million at 0.75.
BAND = 5
BANDS = BINS // BAND
#: Each round of stars in the finer buckets has that many times the centres of the one before.
MORE_STARS = 16
#: Links from which on those of a hot node are looked for and joined apart.
HOT_LINKS = 1 << 15
#: Cells in which shingles are counted to tell rare from frequent ones.
CELLS = 1 << 20
#: Largest side, in estimated bytes, that a join here broadcasts.  The driver holds it as collected rows, as a
#: hash table and as blocks, some ten times the estimate, and builds several of one plan at once.
SENT_BYTES = 8 << 20


def join_small(left: DataFrame, right: DataFrame, on: str, how: str, row_bytes: int) -> DataFrame:
    return _join_small(left, right, on, how, row_bytes, SENT_BYTES)


def join_sized(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    return _join_sized(rows, side, key, limit=SENT_BYTES)


@lru_cache
def _probes() -> np.ndarray:
    """For each bin, all bins in the order in which an empty bin looks for a full one.

    Each bin has an order of its own, which is the point of optimal densification: two
    bins borrow independently.
    """
    random = np.random.Generator(np.random.PCG64(7))
    return np.stack([random.permutation(BINS) for _ in range(BINS)])


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least hash of each bin; an empty bin borrows from the first full bin of its order.

    ``shingles`` are a set's hashes in ascending order, at least one.
    """
    bins = (shingles >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    full = np.zeros(BINS, bool)
    full[bins[first]] = True
    out = np.zeros(BINS, np.uint64)
    out[bins[first]] = shingles[first]
    empty = np.flatnonzero(~full)
    if len(empty):
        order = _probes()[empty]
        out[empty] = out[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
    return out


def _band_hashes(signatures: np.ndarray) -> np.ndarray:
    """A hash of each band, different for equal values in different bands."""
    parts = signatures[:, : BANDS * BAND].reshape(len(signatures), BANDS, BAND)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    for k in range(BAND):
        out = mix(out + parts[:, :, k])
    return out


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The ascending distinct shingle hashes of each text."""
    for words in text_words(column, lower=True):
        yield np.unique(shingle_hashes(words, width))


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys = [], []
            signatures = np.zeros((batch.num_rows, BINS), np.uint64)
            for row, shingles in enumerate(_sets(batch.column(1), width)):
                sizes.append(len(shingles))
                # two independent sums over the set stand for it
                keys.append(shingles.sum(dtype=np.uint64).tobytes() + mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).tobytes())
                if len(shingles):
                    signatures[row] = signature(shingles)
            bands = _band_hashes(signatures).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.ravel()))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists], ["id", "n_shingles", "set_key", "bands"])

    return run


def _shingle_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in _sets(batch.column(1), width)]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], ["rep", "shingles"])

    return run


def _near(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(percent: int):
    """Links from rows (u, part, v, shingles) sorted so that a star's centre, with null v, comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres: list[np.ndarray] = []
        begun = False  # whether the rows before are sets of the centre, of which a repeated key has several
        for batch in batches:
            u, v = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            good = []
            for row, other in enumerate(batch.column(3)):
                shingles = np.frombuffer(other.as_buffer(), np.uint64)
                if v[row] is None:
                    centres = [*centres, shingles.copy()] if begun else [shingles.copy()]
                elif any(_near(centre, shingles, percent) for centre in centres):
                    good.append(row)
                begun = v[row] is None
            yield pa.record_batch([pa.array([u[i] for i in good], pa.int64()), pa.array([v[i] for i in good], pa.int64())], ["u", "v"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those ``pairs`` (u, v) whose ``sets`` (rep, shingles) are near enough.

    Each member's set goes to its star once, and the centre's set once for every
    ``HOT_ROWS`` members, so that a large star is dealt over several tasks.
    """
    stars = pairs.groupBy("u").agg((F.floor(F.count("*") / HOT_ROWS) + 1).alias("parts"))
    stars = gathered(stars)
    parted = gathered(join_small(pairs, stars, "u", "inner", 24).select("u", "v", F.pmod(F.xxhash64("v"), F.col("parts")).alias("part")))
    members = join_small(sets, parted.withColumnRenamed("v", "rep"), "rep", "inner", 32).select("u", "part", F.col("rep").alias("v"), "shingles")
    centres = join_small(sets, stars.withColumnRenamed("u", "rep"), "rep", "inner", 24)
    centres = centres.select(F.col("rep").alias("u"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("v"), "shingles")
    rows = members.unionByName(centres).repartition("u", "part").sortWithinPartitions("u", "part", F.asc_nulls_first("v"))
    return gathered(rows.mapInArrow(_confirm(percent), "u long, v long"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for undirected ``links`` (u, v); the component is its least node.

    Alternates large-star and small-star steps until the links are stars; each step
    shuffles the links once, those of a hot node apart, and none is sent to the driver.
    Each step's links are stored, since their joins would multiply estimated sizes.
    """
    edges = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    now = before = None
    while True:
        wide = now is not None and now[0] > HOT_LINKS

        def joined(rows: DataFrame, least: DataFrame, wide: bool = wide) -> DataFrame:
            return join_sized(rows, gathered(least), "u") if wide else rows.join(least, "u")

        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("size"))
        down = joined(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = gathered(down) if wide else down
        least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size"))
        small = joined(down, least).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stored(small.select("e.*").where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return gathered(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots))
        before = now


class _Links:
    """Pairs compared so far and the components of the links among them."""

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent = sets, percent
        self.tried: DataFrame | None = None
        self.found: DataFrame | None = None

    def of(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the component of their ``rep``."""
        if self.found is None:
            return rows.withColumn("component", F.col("rep"))
        known = join_small(rows, self.found.withColumnRenamed("node", "rep"), "rep", "left", 24)
        return known.withColumn("component", F.coalesce("component", "rep"))

    def compare(self, pairs: DataFrame) -> None:
        pairs = pairs if self.tried is None else pairs.join(self.tried, ["u", "v"], "left_anti")
        pairs = gathered(pairs)
        links = confirmed(pairs, self.sets, self.percent)
        if self.found is None:
            self.found = components(links)
        elif not links.isEmpty():
            self.found = components(self.found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links))
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        self.tried = both if self.tried is None else self.tried.unionByName(both)


def _shared(members: DataFrame) -> DataFrame:
    """Members (bucket, rep, n, at) of buckets that have several, with the bucket's size and their own number of mates."""
    sizes = gathered(members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    shared = gathered(join_sized(members, sizes, "bucket"))
    mates = gathered(shared.groupBy("rep").agg(F.sum(F.col("size") - 1).alias("mates")))
    return gathered(join_small(shared, mates, "rep", "inner", 24).select("bucket", "size", "rep", "n", "at", "mates"))


def _parts():
    """In how many parts a bucket is dealt, and the part of a member."""
    parts = F.floor(F.col("size") / HOT_ROWS) + 1
    return parts, F.pmod(F.xxhash64("rep"), parts)


def _unsettled(state: DataFrame) -> DataFrame:
    """Members of buckets that still hold several components."""
    several = gathered(state.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("bucket"))
    return gathered(join_small(state, several, "bucket", "left_semi", 24))


def _pairs(near: DataFrame) -> DataFrame:
    """Each pair of ``near`` (u, rep) once, whichever of the two is the centre."""
    pairs = near.groupBy(F.least("u", "rep").alias("low"), F.greatest("u", "rep").alias("high")).agg(F.max("u").alias("u"))
    return pairs.select("u", F.when(F.col("u") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("v"))


def _first_stars(state: DataFrame, links: _Links, percent: int) -> DataFrame:
    """Compares the best connected member of each part of a bucket with the others; returns those left.

    The centres of a bucket's parts form a star of their own.
    """
    parts, part = _parts()
    best = Window.partitionBy("bucket", "part").orderBy(F.desc("mates"), "rep")
    placed = state.withColumn("part", part).select("bucket", "size", "rep", "n", F.row_number().over(best).alias("place"), F.first("rep").over(best).alias("u"), F.first("n").over(best).alias("un"))
    placed = gathered(placed)
    near = placed.select("u", "un", "rep", "n")
    heads = placed.where((F.col("place") == 1) & (parts > 1))
    among = Window.partitionBy("bucket").orderBy("rep")  # a row a part
    near = near.unionByName(heads.select(F.first("rep").over(among).alias("u"), F.first("n").over(among).alias("un"), "rep", "n"))
    near = near.where("rep <> u").where(F.least("n", "un") * 100 >= F.greatest("n", "un") * percent)
    links.compare(_pairs(near))
    return links.of(placed.where((F.col("place") > 1) | (parts > 1)).select("bucket", "rep"))


def _more_stars(state: DataFrame, stars: int, links: _Links, percent: int) -> DataFrame:
    """Compares ``stars`` members of each bucket with all others; returns those that were no centre.

    ``at`` is the number of a member's shingles that are certainly not common to two
    members which meet first in this bucket.  Parts of a bucket give centres in turn.
    """
    parts, part = _parts()
    best = Window.partitionBy("bucket", "part").orderBy(F.desc("mates"), "rep")
    state = gathered(state.withColumn("part", part).withColumn("place", F.row_number().over(best)))
    turn = (F.col("place") - 1) * parts + F.col("part")
    centres = state.where(turn < stars).select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.col("rep").alias("u"), F.col("n").alias("un"), F.col("at").alias("ua"), F.col("component").alias("uc"))
    near = state.join(centres, ["bucket", "part"]).where("component <> uc")
    near = near.where(F.least(F.col("n") - F.col("at"), F.col("un") - F.col("ua")) * (100 + percent) >= (F.col("n") + F.col("un")) * percent)
    near = near.where(F.least("n", "un") * 100 >= F.greatest("n", "un") * percent)
    links.compare(_pairs(near))
    return links.of(state.where(turn >= stars).drop("component", "place", "part"))


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(CELLS - 1)).astype(np.int64)


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CELLS, np.int64)
    for batch in batches:
        for row in batch.column(0):
            np.add.at(counts, _cells(np.frombuffer(row.as_buffer(), np.uint64)), 1)
    full = np.flatnonzero(counts)
    yield pa.record_batch([pa.array(full), pa.array(counts[full])], ["cell", "n"])


#: Cells whose counts are packed in one row.
_PACKED = 1 << 16


def _pack(rows: pa.Table) -> pa.Table:
    """The counts of one range of cells as bytes."""
    cell, n = rows.column("cell").to_numpy(), rows.column("n").to_numpy()
    counts = np.zeros(_PACKED, np.uint32)
    counts[cell % _PACKED] = np.minimum(n, 2**32 - 1)
    return pa.table({"block": pa.array([int(cell[0]) // _PACKED], pa.int64()), "counts": pa.array([counts.tobytes()], pa.binary())})


def _rarest(counts, percent: int):
    """For each set a row for each of its rarest shingles that may be a bucket, with its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        for batch in batches:
            reps, sizes, at, buckets = [], [], [], []
            for rep, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shingles = np.frombuffer(row.as_buffer(), np.uint64)
                n = len(shingles)
                order = np.lexsort((shingles, often[_cells(shingles)]))[: n - -(-percent * n // 100) + 1]
                mine = np.flatnonzero(often[_cells(shingles[order])] > 1)  # a cell counted once has no other text's shingle
                reps.append(np.full(len(mine), rep))
                sizes.append(np.full(len(mine), n))
                at.append(mine)
                buckets.append(shingles[order[mine]].view(np.int64))
            columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (reps, sizes, at, buckets)]
            yield pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], ["rep", "n", "at", "bucket"])

    return run


def _rare_buckets(sets: DataFrame, percent: int) -> DataFrame:
    """Members (rep, n, at, bucket) of buckets of rare shingles.

    Shingles are put in one order for all texts, those of less counted cells first.  Two
    texts that are near enough share one of their first shingles, as many as may be
    missing and one more; the order decides how large buckets get, not what is found.
    """
    cells = sets.select("shingles").mapInArrow(_count_cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    packed = gathered(cells.groupBy(F.expr(f"cell div {_PACKED}")).applyInArrow(_pack, "block long, counts binary"))
    counts = np.zeros(CELLS, np.uint32)
    for row in packed.collect():  # four bytes a cell, whatever the input
        counts[row["block"] * _PACKED :][:_PACKED] = np.frombuffer(row["counts"], np.uint32)
    shared = sets.sparkSession.sparkContext.broadcast(counts)
    return cut(sets.select("rep", "shingles").mapInArrow(_rarest(shared, percent), "rep long, n long, at long, bucket long"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every document.

    A document's set has its distinct windows of ``width`` words, A-Z folded; fewer words
    make one window of all; a text without words, or null, has none and stands alone.
    Two documents are linked when 100 * common >= ``percent`` * united shingles, and
    ``component_id`` is the least key reachable over links found.

    Documents of equal sets become one before buckets are made, so copies add no pairs.
    A round of stars compares each bucket's best connected member with the others.
    Members of buckets that still hold several components meet again in buckets of rare
    shingles, where a bucket ends only when all its members were compared or are
    connected: every near pair of them is found.
    Keys are whole numbers.  Several texts with one key are linked like one that is near
    to whatever any of them is near to.  A text with a null key gets the component of its
    copies with a key, else null.  An empty table gives an empty result.  Other columns play no part;
    repeated rows with the same key give repeated result rows.
    """
    source = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    sketches = cut(source.mapInArrow(_sketches(width), f"id {docs.schema[key].dataType.simpleString()}, n_shingles long, set_key binary, bands array<long>"))
    real = sketches.where("n_shingles > 0")
    classes = real.groupBy("set_key").agg(F.min("id").cast("long").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("size"))
    rows = gathered(classes)
    members = rows.select("rep", "n", F.lit(0).cast("long").alias("at"), F.explode("bands").alias("bucket")).where("rep is not null")
    state = _shared(members)
    wanted = gathered(state.select(F.col("rep").alias("id")).distinct())
    texts = join_small(source.where("id is not null"), wanted, "id", "left_semi", 16)
    sets = cut(texts.mapInArrow(_shingle_sets(width), "rep long, shingles binary"))

    links = _Links(sets, percent)
    state = _unsettled(_first_stars(state, links, percent))
    if not state.isEmpty():
        apart = gathered(state.select("rep").distinct())
        state = _shared(_rare_buckets(join_small(sets, apart, "rep", "left_semi", 16), percent))
        state, stars = _unsettled(links.of(state)), 1
        while not state.isEmpty():
            state = _unsettled(_more_stars(state, stars, links, percent))
            stars *= MORE_STARS

    own = rows.select("set_key", "size", "rep")
    own = gathered(own.join(links.found.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", "size", F.coalesce("component", "rep").alias("component")))
    keyed = sketches.select("id", "n_shingles", "set_key")
    out = join_sized(keyed.where("n_shingles > 0"), own, "set_key").select("id", "n_shingles", "component")
    out = out.unionByName(keyed.where("n_shingles = 0").select("id", "n_shingles", F.lit(None).cast("long").alias("component")))
    out = out.select(F.col("id").alias(key), "n_shingles", F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
