"""The processing ledger as keyed state: each file's events are folded as they come, late and repeated ones too.

The state of a file is the fold of its events up to the watermark, and the events after it in order of (time, id).
A batch adds its events to those and gives the file's row after all of them; when the watermark passes,
an event-time timer folds what can no longer be preceded and drops it from the state.  So no batch reads events of another,
and the state of a file holds only its events of the last ``delay``.

An event counts once: one that waits is known by (time, id), and an older one comes after the watermark, where Spark
drops it, or is not after the last one folded.  Events later than ``delay`` are dropped; Spark counts them in the
progress of the stream.  With ``forget``, a file that has been stable that long leaves the state; its row stays in
the table, and if more events come, they are folded as those of a new file.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..schema import STABLE_STATUSES
from .runs import with_rocks
from .table import KeyedTable

FIELDS = "status string, content_hash string, flagged boolean, error string, created_at bigint, updated_at bigint"
STATE = f"folded struct<{FIELDS.replace(' string', ':string').replace(' boolean', ':boolean').replace(' bigint', ':bigint')}>, last_at bigint, last_id bigint, waiting array<struct<at:bigint,event_id:bigint,op:string,content_hash:string>>"
ROW = f"file_id bigint, {FIELDS}, part_of bigint"
TABLE = "file_id BIGINT, status STRING, content_hash STRING, flagged BOOLEAN, error STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"

File = tuple[str | None, str | None, bool | None, str | None, int | None, int | None]
Event = tuple[int, int, str, str | None]
NEW: File = (None, None, None, None, None, None)


def after(file: File, event: Event) -> File:
    """A file after one event, by the rule of ``operators.ledger.step``."""
    status, content_hash, flagged, error, created, updated = file
    at, event_id, op, new_hash = event
    if op == "enqueue":
        if status in STABLE_STATUSES and content_hash is not None and content_hash == new_hash:
            return file
        return "queued", new_hash, bool(flagged), None, at if created is None else created, at
    if status is None:
        return file
    flagged = True if op == "flag" else False if op == "done" else flagged
    error = None if op in ("done", "flag") else f"event {event_id}" if op == "failed" else error
    return "flagged" if op == "flag" else op, content_hash, flagged, error, created, at


def folded(file: File, events: list[Event]) -> File:
    for e in events:
        file = after(file, e)
    return file


class FileLedger(StatefulProcessor):
    """State of one file; times are microseconds."""

    def __init__(self, forget_ms: int | None = None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("file", STATE)

    def load(self) -> tuple[File, tuple[int, int], list[Event]]:
        if not self.state.exists():
            return NEW, (-(1 << 62), 0), []
        file, at, event_id, waiting = self.state.get()
        return tuple(file), (at, event_id), [tuple(e) for e in waiting]

    def settle(self, file: File, last: tuple[int, int], waiting: list[Event], watermark_ms: int) -> tuple[File, tuple[int, int], list[Event]]:
        """Folds the events before the watermark."""
        n = sum(e[0] < watermark_ms * 1000 for e in waiting)
        return folded(file, waiting[:n]), waiting[n - 1][:2] if n else last, waiting[n:]

    def save(self, file: File, last: tuple[int, int], waiting: list[Event]) -> None:
        self.state.update((file, *last, waiting))
        if waiting:
            self.handle.registerTimer(waiting[-1][0] // 1000 + 1)
        elif self.forget_ms is not None and file[0] in STABLE_STATUSES:
            self.handle.registerTimer(file[5] // 1000 + self.forget_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        file, last, waiting = self.load()
        known = {e[:2]: e for e in waiting}
        for r in rows:
            if (r.at_us, r.event_id) > last:
                known.setdefault((r.at_us, r.event_id), (r.at_us, r.event_id, r.op, r.content_hash))
        file, last, waiting = self.settle(file, last, [known[k] for k in sorted(known)], timerValues.getCurrentWatermarkInMs())
        self.save(file, last, waiting)
        now = folded(file, waiting)
        if now[0] is not None:
            yield Row(file_id=key[0], **dict(zip((f.split()[0] for f in FIELDS.split(", ")), now, strict=True)), part_of=len(waiting))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            file, last, waiting = self.settle(*self.load(), timerValues.getCurrentWatermarkInMs())
            stable = not waiting and self.forget_ms is not None and file[0] in STABLE_STATUSES
            if stable and file[5] // 1000 + self.forget_ms <= expiredTimerInfo.getExpiryTimeInMs():
                self.state.clear()
            elif waiting:
                self.state.update((file, *last, waiting))
            else:
                self.save(file, last, waiting)
        yield from ()

    def close(self) -> None:
        pass


def ledger_table(spark: SparkSession, folder: str, buckets: int = 64) -> KeyedTable:
    return KeyedTable(spark, f"{folder}/ledger", TABLE, "file_id", buckets)


def folding(events: DataFrame, folder: str, delay: str = "1 hour", forget_ms: int | None = None, buckets: int = 64) -> StreamingQuery:
    """Starts the stream that folds events (file_id, ts, event_id, op, content_hash) into the table below ``folder`` until its source is empty.

    A batch changes the rows of its files only.  The checkpoint with the state lies beside the table.
    """
    spark = events.sparkSession
    table = ledger_table(spark, folder, buckets)
    at = F.col("ts").cast("timestamp")
    timed = events.select("file_id", "event_id", "op", "content_hash", at.alias("at"), F.unix_micros(at).alias("at_us")).withWatermark("at", delay)

    def put(batch: DataFrame, number: int) -> None:
        moment = lambda c: F.timestamp_micros(c).cast("timestamp_ntz").alias(c)
        table.merge(batch.select("file_id", "status", "content_hash", "flagged", "error", moment("created_at"), moment("updated_at")), number + 1)
        table.prune()

    with with_rocks(spark):
        rows = timed.groupBy("file_id").transformWithState(FileLedger(forget_ms), ROW, "Update", "EventTime")
        return rows.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{folder}/ledger-checkpoint").trigger(availableNow=True).start()


def run_to_end(events: DataFrame, folder: str, delay: str = "1 hour", forget_ms: int | None = None, buckets: int = 64) -> DataFrame:
    """Drains a stream of events; the table is the result."""
    folding(events, folder, delay, forget_ms, buckets).awaitTermination()
    return ledger_table(events.sparkSession, folder, buckets).read()
