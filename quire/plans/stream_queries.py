"""Streaming queries over the event and page tables, each with the batch result as its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import enqueue
from ..sources.files import once
from ..storage import keep, scratch
from ..streaming import ledger
from ..streaming import quality as Q
from ..streaming.runs import drained, staged
from ..streaming.sessions import sessions
from . import derive
from .corpus_queries import QC_CURRENT, ROUTE, docs, file_sanity, page_records
from .ledger_queries import ENQUEUED, LEDGER, batch, files, with_now
from .registry import query


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream; the file source takes a folder, so the table's own path is a glob."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parque[t]")


@query("SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM events GROUP BY event_type")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events drained through a stream, each id once, and counted."""
    rows = drained(event_stream(spark, sf_dir).dropDuplicates(["event_id"]).select("event_type", "value"), scratch(spark))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query(f"WITH {LEDGER} SELECT file_id, status, content_hash, flagged, error, created_at, updated_at FROM led")
def stream_ledger_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as keyed state, from the event table as one batch."""
    return ledger.run_to_end(derive.file_events(event_stream(spark, sf_dir)), scratch(spark), buckets=8)


def in_disorder(events: DataFrame, slots: int = 5) -> tuple[DataFrame, int]:
    """(events with the slot in which they arrive, the least delay in seconds that loses none).

    Each is up to half a slot late by a hash of its id, and every seventh comes again in the next slot.
    """
    ends = events.agg(F.unix_seconds(F.min("ts").cast("timestamp")).alias("a"), F.unix_seconds(F.max("ts").cast("timestamp")).alias("b")).first()
    width = max(1, -(-(ends.b - ends.a + 1) // slots)) if ends.a is not None else 1
    at = F.unix_seconds(F.col("ts").cast("timestamp")) - F.lit(ends.a or 0) + F.pmod(F.xxhash64("event_id"), F.lit(max(1, width // 2)))
    slot = F.least(F.floor(at / width), F.lit(slots - 1)).cast("int")
    again = F.when(F.col("event_id") % 7 == 0, F.array(slot, F.least(slot + 1, F.lit(slots - 1)))).otherwise(F.array(slot))
    return events.withColumn("slot", F.explode(again)), width


@query(f"WITH {LEDGER} SELECT file_id, status, content_hash, flagged, error, created_at, updated_at FROM led")
def stream_ledger_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from five batches that overlap in time, some events twice; no batch reads those of another."""
    folder = scratch(spark)
    dealt, late = in_disorder(derive.file_events(derive.read(spark, sf_dir, "events")))
    return ledger.run_to_end(staged(dealt, "slot", 5, f"{folder}/in"), folder, f"{late} seconds", buckets=8)


@query(ENQUEUED)
def ledger_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as a table of buckets: its rows, then only those that a batch of inputs changes, merged as deltas."""
    before = files(spark, sf_dir).drop("id")
    table = ledger.ledger_table(spark, scratch(spark), buckets=16)
    table.merge(before, 1)
    new = with_now(batch(spark, sf_dir), spark, sf_dir)
    table.merge(enqueue(table.of(new), new, "now").exceptAll(table.read()), 2)
    return table.read()


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: events per hour, streamed with a watermark and complete output."""
    s = event_stream(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour")
    counted = s.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
    return drained(counted, scratch(spark), "complete")


@query("WITH w AS (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start, value FROM events) SELECT start, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM w GROUP BY start")
def window_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: hourly windows every half hour."""
    e = derive.read(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("at", "1 hour", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def window_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: sessions of each user with gaps under half an hour."""
    e = derive.read(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("at", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


DEDUP = """arrivals AS (SELECT '/in/' || user_id || '/' || event_id AS path, event_type AS content_hash, ts AS modified, event_id FROM events),
again AS (SELECT path, content_hash, modified FROM arrivals UNION ALL SELECT path, content_hash, modified + INTERVAL 10 DAY FROM arrivals WHERE event_id % 5 = 0 UNION ALL SELECT path, 'changed', modified + INTERVAL 20 MINUTE FROM arrivals WHERE event_id % 4 = 0)"""


@query(f"WITH {DEDUP} SELECT * FROM again")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that come again: within the delay they go; changed ones, and those that come again days later, stay."""
    e = derive.read(spark, sf_dir, "events").select(F.format_string("/in/%d/%d", "user_id", "event_id").alias("path"), F.col("event_type").alias("content_hash"), F.col("ts").cast("timestamp").alias("modificationTime"), "event_id")
    copy = lambda n, span, hash_="content_hash": e.where(F.col("event_id") % n == 0).withColumns({"modificationTime": F.col("modificationTime") + F.expr(f"INTERVAL {span}"), "content_hash": F.expr(hash_)})
    rows = e.union(copy(3, "10 MINUTES")).union(copy(5, "10 DAYS")).union(copy(4, "20 MINUTES", "'changed'")).drop("event_id")
    first = rows.agg(F.min("modificationTime").alias("a"), F.max("modificationTime").alias("b")).first()
    slots = 1 if first.a is None else (first.b - first.a).days // 3 + 1
    slot = F.floor((F.unix_seconds("modificationTime") - F.unix_seconds(F.lit(first.a))) / (3 * 86400)).cast("int")
    folder = scratch(spark)
    seen = once(staged(rows.withColumn("slot", slot), "slot", slots, f"{folder}/in"), "1 hour")
    return drained(seen, folder).select("path", "content_hash", F.col("modificationTime").cast("timestamp_ntz").alias("modified"))


LATE = """span AS (SELECT min(ts) AS a FROM events), dealt AS (SELECT user_id, event_id, ts, CAST((epoch_us(ts) - epoch_us(a)) // 1000000 + CASE WHEN event_id % 40 = 0 THEN 864000 ELSE event_id * 7919 % 43200 END AS BIGINT) // 432000 AS slot FROM events, span),
tops AS (SELECT slot, max(ts) AS top FROM dealt GROUP BY slot), marks AS (SELECT slot, max(top) OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 12 HOUR AS mark FROM tops),
seen AS (SELECT d.*, coalesce(epoch_us(ts) < epoch_ms(mark) * 1000, false) AS late FROM dealt d JOIN marks USING (slot)), final AS (SELECT epoch_ms(max(ts) - INTERVAL 12 HOUR) * 1000 AS mark FROM events),
g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM seen WHERE NOT late WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
closed AS (SELECT user_id, min(ts) AS first, max(ts) AS last, count(*)::BIGINT AS n FROM k GROUP BY user_id, k)"""


def late_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions over events that arrive up to half a day late, and some ten days late."""
    e = derive.read(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    first = e.agg(F.unix_seconds(F.min("ts").cast("timestamp")).alias("a"), F.unix_seconds(F.max("ts").cast("timestamp")).alias("b")).first()
    late = F.when(F.col("event_id") % 40 == 0, 864000).otherwise(F.col("event_id") * 7919 % 43200)
    slots = 1 if first.a is None else (first.b - first.a + 864000) // 432000 + 1
    folder = scratch(spark)
    dealt = e.withColumn("slot", F.floor((at - F.lit(first.a) + late) / 432000).cast("int"))
    return sessions(staged(dealt, "slot", slots, f"{folder}/in"), "user_id", "ts", 1800, "12 hours", folder)


@query(f"WITH {LATE} SELECT user_id, first, last, n FROM closed, final WHERE epoch_us(last) + 1800000000 <= final.mark")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed sessions of each user."""
    return late_sessions(spark, sf_dir).where("NOT late").drop("late")


@query(f"WITH {LATE} SELECT user_id, ts AS at FROM seen WHERE late")
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that came behind the watermark."""
    return late_sessions(spark, sf_dir).where("late").select("user_id", F.col("first").alias("at"))


@query(f"WITH {QC_CURRENT} SELECT cur.*, curwins.wins FROM cur, curwins")
def qc_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current quality from totals folded in four batches, a third of the files recorded twice."""
    folder = scratch(spark)
    d = docs(spark, sf_dir)
    routes = file_sanity(d).selectExpr("doc_id", f"{ROUTE} AS route")
    last = page_records(d).join(routes, "doc_id").select("doc_id", "source", F.lit(2).cast("long").alias("seq"), "route", "mean_confidence", "wins_primary", "wins_secondary", (F.col("doc_id") % 4).cast("int").alias("slot"))
    last = keep(last, "records")
    first = last.where("doc_id % 3 = 0").withColumns({"seq": F.lit(1).cast("long"), "route": F.lit("ocr"), "mean_confidence": F.lit(1.5), "slot": ((F.col("doc_id") + 1 + F.col("doc_id") % 2) % 4).cast("int")})
    Q.folding(staged(last.union(first), "slot", 4, f"{folder}/in"), folder, buckets=8).awaitTermination()
    return Q.current(spark, folder)
