"""The frontier of a crawl as a stream: each address's state, kept between runs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row

TERMINAL = ("succeeded", "skipped")
ENDED = (*TERMINAL, "failed")

_SNAPSHOT = T.StructType([T.StructField("state", T.StringType()), T.StructField("attempts", T.LongType()), T.StructField("last_error", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("ended", T.LongType()), T.StructField("known", T.LongType())])
_CHANGE = T.StructType([T.StructField("seq", T.LongType()), T.StructField("state", T.StringType()), T.StructField("error", T.StringType()), T.StructField("at", T.LongType())])
#: What a stream puts out for each address that a batch touches; ``known`` grows with what is known of it.
ENTRY = "url string, state string, attempts long, last_error string, seq long, known long"


def _replayed(snapshot: tuple | None, changes: dict[int, tuple]) -> tuple:
    """(state, attempts, last_error, seq, seq of the last end, transitions known) after more transitions, in order of seq.

    Whatever ends an attempt sets or clears the error; the rest leaves it.  An older transition counts
    as an attempt, but does not change what newer ones left.
    """
    state, attempts, error, last, ended, known = snapshot or ("queued", 0, None, -1, -1, 0)
    for seq in sorted(changes):
        name, message, _ = changes[seq]
        known += 1
        attempts += name == "processing"
        if seq >= last:
            state, last = name, seq
        if name in ENDED and seq >= ended:
            error, ended = message, seq
    return state, attempts, error, last, ended, known


class Entries(StatefulProcessor):
    """A snapshot of each address, and a journal of the transitions that the watermark has not passed.

    A transition that comes twice is known by its number as long as it is in the journal; the
    stream drops those older than the watermark.  When the watermark passes transitions, the timer
    folds them into the snapshot, so that state stays as small as the lateness allowed.  The journal is read
    and written whole, once for all rows of an address in a batch: each call to the state crosses processes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.snapshot = handle.getValueState("snapshot", _SNAPSHOT)
        self.journal = handle.getListState("journal", _CHANGE)

    def _state(self) -> tuple[tuple | None, dict[int, tuple]]:
        held = self.snapshot.get() if self.snapshot.exists() else None
        return (tuple(held) if held is not None else None), {seq: change for seq, *change in self.journal.get()}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803  the interface's names
        snapshot, journal = self._state()
        fresh: dict[int, tuple] = {}
        for row in rows:
            if row.seq not in journal and row.seq not in fresh:
                fresh[row.seq] = (row.state, row.error, int(row.at.timestamp() * 1000))
        if fresh:
            self.journal.appendList([(seq, *change) for seq, change in fresh.items()])
            self.handle.registerTimer(max(0, *(at for _, _, at in fresh.values())))
        journal |= fresh
        state, attempts, error, seq, _, known = _replayed(snapshot, journal)
        yield Row(url=key[0], state=state, attempts=attempts, last_error=error, seq=seq, known=known)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        snapshot, journal = self._state()
        passed = {seq: change for seq, change in journal.items() if change[2] <= expiredTimerInfo.getExpiryTimeInMs()}
        if passed:
            left = [(seq, *change) for seq, change in journal.items() if seq not in passed]
            self.journal.put(left) if left else self.journal.clear()
            self.snapshot.update(_replayed(snapshot, passed))
        return iter([])

    def close(self) -> None:
        pass


def run_folder(base: str, start_url: str, settings: dict) -> str:
    """The folder of a run's checkpoint: another start or other settings are another run, with nothing known."""
    wanted = json.dumps({"start_url": start_url, "settings": settings}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return f"{base}/{hashlib.sha256(wanted.encode()).hexdigest()[:24]}"


def frontier_entries(log: DataFrame, watermark: str = "1 day") -> DataFrame:
    """A stream of entries from a stream of transitions (url, seq, state, error, at), read in ``runs.stateful_session``.

    Transitions may come late, by ``watermark``, out of order and more than once.  Rows without an
    address, a number or a time are none.
    """
    rows = log.where("url is not null and seq is not null and at is not null and state is not null").select("url", "seq", "state", "error", F.col("at").cast("timestamp").alias("at"))
    return rows.withWatermark("at", watermark).groupBy("url").transformWithState(Entries(), ENTRY, "Update", "EventTime")


def latest_entries(updates: DataFrame) -> DataFrame:
    """The last entry of each address among a stream's updates."""
    newest = updates.groupBy("url").agg(F.max_by(F.struct("state", "attempts", "last_error", "seq"), F.struct("known", "seq")).alias("e"))
    return newest.select("url", "e.*")


def batch_entries(log: DataFrame) -> DataFrame:
    """The same entries of a whole log, as an aggregate."""
    rows = log.where("url is not null and seq is not null and at is not null and state is not null")
    once = rows.groupBy("url", "seq").agg(F.min(F.struct("state", "error")).alias("t"))
    ended = F.col("t.state").isin(*ENDED)
    last_error = F.max_by(F.when(ended, F.struct(F.col("t.error").alias("error"))), F.when(ended, F.col("seq")))
    return once.groupBy("url").agg(F.max_by("t.state", "seq").alias("state"), F.sum((F.col("t.state") == "processing").cast("long")).alias("attempts"), last_error["error"].alias("last_error"), F.max("seq").alias("seq"))


def unfinished(entries: DataFrame) -> DataFrame:
    """Addresses still to be fetched: all but those that succeeded or were skipped."""
    return entries.where(~F.col("state").isin(*TERMINAL))


def transition(name: Column) -> Column:
    """The state that an event's name stands for; a name that stands for none queues the address."""
    known = F.create_map(*[F.lit(x) for pair in {"add": "queued", "fetch": "processing", "save": "succeeded", "skip": "skipped", "error": "failed"}.items() for x in pair])
    return F.coalesce(known[F.lower(name)], F.lit("queued"))
