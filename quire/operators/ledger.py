"""The processing ledger: a fold of file events, batch upserts, and its reports.

Snapshots are immutable; a change is a new table by key.  Ties in time fall back on the event id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import STABLE_STATUSES

INTERRUPTED = "interrupted by restart"
STATE = "struct<status:string,content_hash:string,flagged:boolean,error:string,created_at:timestamp_ntz,updated_at:timestamp_ntz>"


def step(s: Column, e: Column) -> Column:
    """The state after one event (ts, event_id, op, content_hash).

    Enqueueing does nothing if the hash is the stored one and the status is stable; otherwise it
    queues the file, keeping when it was created and whether it was flagged.  Other operations on a
    file never enqueued do nothing.
    """
    known = s["status"].isNotNull()
    enqueue = e["op"] == "enqueue"
    same = known & (s["content_hash"] == e["content_hash"]) & s["status"].isin(*STABLE_STATUSES)
    queued = F.struct(F.lit("queued").alias("status"), e["content_hash"].alias("content_hash"), F.coalesce(s["flagged"], F.lit(False)).alias("flagged"), F.lit(None).cast("string").alias("error"), F.coalesce(s["created_at"], e["ts"]).alias("created_at"), e["ts"].alias("updated_at"))
    status = F.when(e["op"] == "flag", "flagged").otherwise(e["op"])
    flagged = F.when(e["op"] == "flag", True).when(e["op"] == "done", False).otherwise(s["flagged"])
    error = F.when(e["op"].isin("done", "flag"), None).when(e["op"] == "failed", F.concat(F.lit("event "), e["event_id"].cast("string"))).otherwise(s["error"])
    moved = F.struct(status.alias("status"), s["content_hash"].alias("content_hash"), flagged.alias("flagged"), error.alias("error"), s["created_at"].alias("created_at"), e["ts"].alias("updated_at"))
    return F.when(enqueue & ~same, queued).when(~enqueue & known, moved).otherwise(s).cast(STATE)


def fold(events: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, status, content_hash, flagged, error, created_at, updated_at): the ledger after all events of each file."""
    history = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "op", "content_hash"))).alias("es"))
    return history.select(key, F.aggregate("es", F.lit(None).cast(STATE), step).alias("s")).where("s IS NOT NULL AND s.status IS NOT NULL").select(key, "s.*")


def with_ids(files: DataFrame, key: str = "file_id") -> DataFrame:
    """Row numbers by time of creation.

    Files are numbered within the minute of their creation, and minutes by the files before them: the
    only window over all is one row per minute, summed up before.
    """
    minute = F.date_trunc("minute", F.col("created_at").cast("timestamp")).alias("_minute")
    timed = files.withColumn("_minute", minute)
    per = timed.groupBy("_minute").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_minute").orderBy("created_at", key))
    numbered = timed.withColumn("_place", place).join(per.select("_minute", before.alias("_before")), "_minute")
    return numbered.withColumn("id", (F.col("_before") + F.col("_place")).cast("long")).drop("_minute", "_place", "_before")


def latest(events: DataFrame, key: str = "file_id") -> DataFrame:
    """The last event of each file: one aggregate, combined before the shuffle."""
    return events.groupBy(key).agg(F.max(F.struct("ts", "event_id", "op", "content_hash")).alias("e")).select(key, "e.*")


def enqueue(files: DataFrame, batch: DataFrame, now: str, key: str = "file_id") -> DataFrame:
    """The ledger after enqueueing a batch (key, content_hash, and its time in the column ``now``)."""
    new = batch.select(key, F.col("content_hash").alias("_new"), F.col(now).alias("_now"))
    now = F.col("_now")
    j = files.join(new, key, "full_outer")
    same = F.col("content_hash").eqNullSafe(F.col("_new")) & F.col("status").isin(*STABLE_STATUSES)
    stays = F.col("_new").isNull() | F.coalesce(same, F.lit(False))
    keep = lambda c, other: F.when(stays, F.col(c)).otherwise(other).alias(c)
    return j.select(key, keep("status", F.lit("queued")), keep("content_hash", F.col("_new")), F.coalesce("flagged", F.lit(False)).alias("flagged"), keep("error", F.lit(None)), F.coalesce("created_at", now).alias("created_at"), keep("updated_at", now))


def needs_processing(inputs: DataFrame, files: DataFrame, key: str = "file_id") -> DataFrame:
    """Inputs (key, content_hash) with no record, another hash, or a status that is not stable."""
    known = files.select(key, F.col("content_hash").alias("_hash"), "status")
    return inputs.join(known, key, "left").where(F.col("status").isNull() | (F.col("_hash") != F.col("content_hash")) | ~F.col("status").isin(*STABLE_STATUSES)).select(key, "content_hash", "status")


def reconcile_interrupted(files: DataFrame) -> DataFrame:
    """Files left in processing fail with a fixed message; doing it again changes nothing."""
    stale = F.col("status") == "processing"
    return files.withColumns({"error": F.when(stale, INTERRUPTED).otherwise(F.col("error")), "status": F.when(stale, "failed").otherwise(F.col("status"))})
