"""Merging records that share any of several keys, in order, the better record of each pair winning.

Records are taken in order.  One whose keys are all free opens a slot; another meets the
slot that holds the first of its keys that is held, and if its quality is higher takes the slot
over: the former holder's keys become free and its own are held.  Else it is dropped,
and holds nothing.

What a record finds depends on those before it, but only on those that opened or took over a slot.
So a set of records that may have done so is guessed and folded in order, group by group of
records that share keys; the fold tells when which key was held by what.  Every other record
looks up its keys as of its turn, all at once.  Those that would have changed something
join the set, until none does: then the fold of the set is that of all records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataloom.lineage import cut
from strataloom.operators.joins import join_split

#: Rounds after which a record joins the set if it is the first with any of its keys, not only with all.
PATIENT_ROUNDS = 6

_EVENTS = "slot long, winner long, key string, since long, until long, held array<long>"


class _Slots:
    """The slots of one group, and since when keys are held."""

    def __init__(self):
        self.slot: dict[str, int] = {}
        self.since: dict[str, tuple[int, list[int]]] = {}
        self.holder: dict[int, tuple[int, list[int], list[str]]] = {}
        self.rows: list[tuple] = []

    def _free(self, key: str, until: int | None) -> None:
        since, quality = self.since.pop(key)
        self.rows.append((self.slot.pop(key), None, key, since, until, quality))

    def _hold(self, slot: int, seq: int, quality: list[int], keys: list[str]) -> None:
        self.holder[slot] = (seq, quality, keys)
        for key in keys:
            if key in self.slot:
                self._free(key, seq)
            self.slot[key], self.since[key] = slot, (seq, quality)

    def take(self, seq: int, quality: list[int], keys: list[str]) -> None:
        slot = next((self.slot[key] for key in keys if key in self.slot), None)
        if slot is None:
            self._hold(seq, seq, quality, keys)
        elif quality > self.holder[slot][1]:
            for key in self.holder[slot][2]:
                if self.slot.get(key) == slot:
                    self._free(key, seq)
            self._hold(slot, seq, quality, keys)

    def close(self) -> None:
        for key in list(self.slot):
            self._free(key, None)
        self.rows += [(slot, seq, None, None, None, None) for slot, (seq, _, _) in self.holder.items()]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, seq, quality, keys), sorted by label and seq, to events; memory follows the slots of one label."""
    schema = pa.schema([("slot", pa.int64()), ("winner", pa.int64()), ("key", pa.string()), ("since", pa.int64()), ("until", pa.int64()), ("held", pa.list_(pa.int64()))])
    of: int | None = None
    slots = _Slots()

    def made() -> pa.RecordBatch:
        rows, slots.rows = slots.rows, []
        return pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    for batch in batches:
        for label, seq, quality, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if label != of:
                slots.close()
                rows, slots = slots.rows, _Slots()
                of, slots.rows = label, rows
            slots.take(seq, quality, keys)
        yield made()
    slots.close()
    yield made()


def key_groups(rows: DataFrame) -> DataFrame:
    """(seq, label): records (seq, keys) that are connected by shared keys get one label, their least seq.

    Labels spread over shared keys, and each label is replaced by its own label, so that long
    chains halve; a round moves a row for each shared key of a record.
    """
    held = rows.select("seq", F.explode("keys").alias("key"))
    shared = held.groupBy("key").agg(F.min("seq").alias("a"), F.max("seq").alias("b")).where("a <> b").select("key")
    pairs = cut(held.join(shared, "key", "left_semi"))
    labels = cut(pairs.select("seq").distinct().withColumn("label", F.col("seq")))
    while True:
        least = pairs.join(labels, "seq").groupBy("key").agg(F.min("label").alias("label"))
        near = pairs.join(least, "key").groupBy("seq").agg(F.min("label").alias("near"))
        own = labels.select(F.col("seq").alias("near"), F.col("label").alias("far"))
        moved = cut(labels.join(near, "seq").join(own, "near").select("seq", F.least("far", "near").alias("label"), (F.least("far", "near") < F.col("label")).alias("moved")))
        labels = moved.select("seq", "label")
        if moved.where("moved").isEmpty():
            return rows.select("seq").join(labels, "seq", "left").select("seq", F.coalesce("label", "seq").alias("label"))


def _first_of_keys(rows: DataFrame, every: bool) -> DataFrame:
    """(seq): rows that come first with all of their keys, or with any."""
    first = rows.select("seq", F.explode("keys").alias("key")).groupBy("key").agg(F.min("seq").alias("seq"))
    times = first.groupBy("seq").agg(F.count("*").alias("times"))
    return rows.join(times, "seq").where(F.col("times") == F.size("keys") if every else F.lit(True)).select("seq")


def _changes(others: DataFrame, events: DataFrame, every: bool) -> DataFrame:
    """(seq): those of ``others`` that would open or take over a slot, as far as they have to be known.

    Of those that would take over one slot, only such count as are better than all before
    them: of each quality the first, and of these the ones with none better before.
    """
    held = events.where("key is not null").select("key", "slot", "since", "until", "held")
    looked = join_split(others.select("seq", "quality", F.posexplode("keys").alias("place", "key")), held, "key", 256)
    there = (F.col("since") < F.col("seq")) & (F.col("until").isNull() | (F.col("until") > F.col("seq")))
    found = looked.groupBy("seq").agg(F.first("quality").alias("quality"), F.min(F.when(there, F.struct("place", "slot", "held"))).alias("found"))
    found = cut(found.where("found is null or quality > found.held").select("seq", "quality", "found.slot"))
    better = found.where("slot is not null").groupBy("slot", "quality").agg(F.min("seq").alias("seq"))
    above = Window.partitionBy("slot").orderBy(F.desc("quality")).rowsBetween(Window.unboundedPreceding, -1)
    better = better.withColumn("sooner", F.min("seq").over(above)).where("sooner is null or seq < sooner").select("seq")
    free = others.join(found.where("slot is null").select("seq"), "seq", "left_semi")
    return cut(better.unionByName(_first_of_keys(free, every)).distinct())


def merge_records(records: DataFrame, seq: str, keys: Column, quality: Column) -> DataFrame:
    """(slot, winner): for each slot the number of the record that opened it, and of the one that holds it at last.

    ``seq`` numbers the records in order, each once; ``keys`` is an array of strings in the order in
    which they are looked up, of which nulls are none; ``quality`` an array of whole numbers, compared
    from the first on.  A record without keys has a slot of its own.  The result is that
    of going through all records in order, however they are dealt.  Records that open or take
    over slots and share keys, directly or by others of them, are folded one after another in
    one task, a batch at a time; all others are looked up where they are.
    """
    rows = cut(records.select(F.col(seq).cast("long").alias("seq"), F.array_distinct(F.array_compact(keys)).alias("keys"), quality.cast("array<long>").alias("quality")))
    free = rows.where("keys is null or size(keys) = 0").select(F.col("seq").alias("slot"), F.col("seq").alias("winner"))
    rows = rows.where("size(keys) > 0")
    known, turn = cut(_first_of_keys(rows, True)), 0
    while True:
        active = cut(rows.join(known, "seq", "left_semi"))
        labelled = active.join(key_groups(active), "seq").select("label", "seq", "quality", "keys")
        events = cut(labelled.repartition("label").sortWithinPartitions("label", "seq").mapInArrow(_fold, _EVENTS))
        turn += 1
        more = _changes(rows.join(known, "seq", "left_anti"), events, turn <= PATIENT_ROUNDS)
        if more.isEmpty():
            return events.where("winner is not null").select("slot", "winner").unionByName(free)
        known = cut(known.unionByName(more))
