"""The cache's log as a stream, whose entries expire by timers."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row

from strataloom.operators.cache import validator

EVENT = "url string, at timestamp, seq long, event string, if_none_match string, if_modified_since string"
_ENTRY = T.StructType([T.StructField("at", T.LongType()), T.StructField("seq", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("checksum", "etag", "last_modified"))])


def _micros(at: datetime) -> int:
    return round(at.replace(tzinfo=at.tzinfo or timezone.utc).timestamp() * 1_000_000)


def _time(micros: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=micros)


class Cache(StatefulProcessor):
    """The entry of each address, with a timer for its end.

    The rows of a batch are taken in the order of their times; an entry older than the one held is
    not stored.
    """

    def __init__(self, ttl_seconds: int):
        self.life = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", _ENTRY)

    def _timer(self, at: int) -> int:
        """The first millisecond by which an entry is over."""
        return (at + self.life) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803  the interface's names
        held = tuple(self.entry.get()) if self.entry.exists() else None
        before = held
        for row in sorted(rows, key=lambda r: (r.at, r.seq)):
            at = _micros(row.at)
            if held and held[0] + self.life < at:
                yield self._over(key, held)
                held = None
            alive = held is not None and held[0] <= at
            if row.fetched:
                event = "unchanged" if alive and held[2] == row.checksum else "stored"
                if held is None or held[0] <= at:
                    held = (at, row.seq, row.checksum, row.etag, row.last_modified)
                yield Row(url=key[0], at=row.at, seq=row.seq, event=event, if_none_match=None, if_modified_since=None)
            else:
                again = alive and bool(row.has_output) and (held[3] is not None or held[4] is not None)
                yield Row(url=key[0], at=row.at, seq=row.seq, event="revalidate" if again else "fetch", if_none_match=held[3] if again else None, if_modified_since=held[4] if again else None)
        if held != before:
            if before:
                self.handle.deleteTimer(self._timer(before[0]))
            if held:
                self.entry.update(held)
                self.handle.registerTimer(self._timer(held[0]))
            else:
                self.entry.clear()

    def _over(self, key, held: tuple) -> Row:
        return Row(url=key[0], at=_time(held[0] + self.life), seq=held[1], event="evicted", if_none_match=None, if_modified_since=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.entry.exists() and self._timer(self.entry.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            held = tuple(self.entry.get())
            self.entry.clear()
            yield self._over(key, held)

    def close(self) -> None:
        pass


def cache_stream(log: DataFrame, ttl_seconds: int, watermark: str = "1 hour") -> DataFrame:
    """The events of ``operators.cache.cache_events`` as they happen, from a stream of the same log.

    Rows later than ``watermark`` are dropped; an entry is evicted when the watermark passes its end, or when a row
    shows it over before that.
    """
    rows = log.where("url is not null and at is not null and seq is not null").withColumn("at", F.col("at").cast("timestamp"))
    rows = rows.select("url", "at", "seq", "fetched", "checksum", validator(F.col("etag")).alias("etag"), validator(F.col("last_modified")).alias("last_modified"), "has_output")
    return rows.withWatermark("at", watermark).groupBy("url").transformWithState(Cache(ttl_seconds), EVENT, "Append", "EventTime")
