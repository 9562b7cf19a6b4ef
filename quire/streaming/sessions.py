"""Sessions of a stream with late rows: state that merges them, and a side table of what came too late.

A session is a run of events of one key with gaps under ``gap``.  The open sessions of a key are its state; a batch
merges its events into them, and joins two where an event between them arrives.  A session closes, and is
given once, when the watermark reaches its last event plus the gap.  An event before the watermark is late: it
could belong to a session already given, so it goes to the late rows, never silently away.  The watermark
column is not handed to the state operator, which would otherwise drop late rows itself.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .runs import drained, with_rocks

OPEN = "spans array<struct<first:bigint,last:bigint,n:bigint>>"

Span = tuple[int, int, int]  # first and last event in microseconds, number of events


def merged(spans: list[Span], gap_us: int) -> list[Span]:
    """Spans in order, those within the gap of each other joined."""
    out: list[Span] = []
    for first, last, n in sorted(spans):
        if out and first - out[-1][1] < gap_us:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


class Sessions(StatefulProcessor):
    def __init__(self, key: str, gap_us: int):
        self.key, self.gap_us = key, gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OPEN)

    def load(self) -> list[Span]:
        found = self.open.get()
        return [tuple(s) for s in found[0]] if found is not None else []

    def wake(self, spans: list[Span]) -> None:
        """One timer, at which the first of the open sessions may close; each call is a message to the JVM."""
        self.handle.registerTimer(-(-(min(last for _, last, _ in spans) + self.gap_us) // 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        fresh: list[Span] = []
        for r in rows:
            if r.at_us < watermark:
                yield Row(**{self.key: key[0]}, late=True, first=r.at_us, last=r.at_us, n=1)
            else:
                fresh.append((r.at_us, r.at_us, 1))
        if fresh:
            spans = merged([*self.load(), *fresh], self.gap_us)
            self.open.update((spans,))
            self.wake(spans)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        spans = self.load()
        rest = [s for s in spans if s[1] + self.gap_us > watermark]
        for first, last, n in spans:
            if last + self.gap_us <= watermark:
                yield Row(**{self.key: key[0]}, late=False, first=first, last=last, n=n)
        if rest:
            if len(rest) < len(spans):
                self.open.update((rest,))
            self.wake(rest)
        elif spans:
            self.open.clear()

    def close(self) -> None:
        pass


def sessions(events: DataFrame, key: str, time: str, gap_seconds: int, delay: str, folder: str) -> DataFrame:
    """(key, late, first, last, n) of a stream drained to its end: closed sessions, and late events, each a row of one."""
    at = F.col(time).cast("timestamp")
    timed = events.select(key, at.alias("at"), F.unix_micros(at).alias("at_us")).withWatermark("at", delay).select(key, "at_us")
    kind = events.schema[key].dataType.simpleString()
    with with_rocks(events.sparkSession):
        found = timed.groupBy(key).transformWithState(Sessions(key, gap_seconds * 1_000_000), f"{key} {kind}, late boolean, first bigint, last bigint, n bigint", "Append", "EventTime")
        rows = drained(found, folder)
    moment = lambda c: F.timestamp_micros(c).cast("timestamp_ntz").alias(c)
    return rows.select(key, "late", moment("first"), moment("last"), "n")
