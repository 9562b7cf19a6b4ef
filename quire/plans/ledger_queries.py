"""Queries on the processing ledger, its reports and the run history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ledger, quality
from . import derive
from .corpus_queries import INPUTS, QC_CURRENT, current_quality, docs
from .registry import query

#: A fixed present for elapsed times: the last moment of the event stream.
EVENTS = """fe AS (SELECT user_id AS file_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'done' WHEN 'purchase' THEN 'flag' ELSE 'failed' END AS op,
  'h' || (coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) % 3) AS content_hash, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"""
LEDGER = f"""RECURSIVE {EVENTS},
st(file_id, i, status, content_hash, flagged, error, created_at, updated_at) AS (
 SELECT file_id, i, CASE WHEN op = 'enqueue' THEN 'queued' END, CASE WHEN op = 'enqueue' THEN content_hash END, CASE WHEN op = 'enqueue' THEN false END, CAST(NULL AS VARCHAR), CASE WHEN op = 'enqueue' THEN ts END, CASE WHEN op = 'enqueue' THEN ts END FROM fe WHERE i = 1
 UNION ALL
 SELECT e.file_id, e.i,
  CASE WHEN noop THEN s.status WHEN op = 'enqueue' THEN 'queued' WHEN op = 'flag' THEN 'flagged' ELSE op END,
  CASE WHEN noop THEN s.content_hash WHEN op = 'enqueue' THEN e.content_hash ELSE s.content_hash END,
  CASE WHEN noop THEN s.flagged WHEN op = 'enqueue' THEN coalesce(s.flagged, false) WHEN op = 'flag' THEN true WHEN op = 'done' THEN false ELSE s.flagged END,
  CASE WHEN noop THEN s.error WHEN op IN ('enqueue', 'done', 'flag') THEN NULL WHEN op = 'failed' THEN 'event ' || e.event_id ELSE s.error END,
  CASE WHEN noop THEN s.created_at WHEN op = 'enqueue' THEN coalesce(s.created_at, e.ts) ELSE s.created_at END,
  CASE WHEN noop THEN s.updated_at ELSE e.ts END
 FROM st s, LATERAL (SELECT *, CASE WHEN op = 'enqueue' THEN coalesce(s.content_hash = fe.content_hash AND s.status IN ('done', 'flagged'), false) ELSE s.status IS NULL END AS noop FROM fe WHERE fe.file_id = s.file_id AND fe.i = s.i + 1) e),
led0 AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY i DESC) = 1),
led AS (SELECT file_id, status, content_hash, flagged, error, created_at, updated_at, row_number() OVER (ORDER BY created_at, file_id)::BIGINT AS id FROM led0 WHERE status IS NOT NULL),
present AS (SELECT max(ts) AS now FROM events)"""
COLUMNS = "id, file_id, status, content_hash, flagged, error, created_at, updated_at"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.file_events(derive.read(spark, sf_dir, "events"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.with_ids(ledger.fold(events(spark, sf_dir))).select(*COLUMNS.split(", "))


def with_now(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``df`` with the column ``now``, one row broadcast to all."""
    return df.crossJoin(F.broadcast(derive.read(spark, sf_dir, "events").agg(F.max("ts").alias("now"))))


def seconds(a: str, b: str) -> F.Column:
    return (F.unix_micros(F.col(b).cast("timestamp")) - F.unix_micros(F.col(a).cast("timestamp"))) / 1e6


@query(f"WITH {LEDGER} SELECT {COLUMNS} FROM led")
def ledger_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir)


@query(f"WITH {EVENTS} SELECT file_id, ts, event_id, op, content_hash FROM fe QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ts DESC, event_id DESC) = 1")
def ledger_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest(events(spark, sf_dir))


@query(f"WITH {LEDGER} SELECT {COLUMNS} FROM led ORDER BY id")
def ledger_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).orderBy("id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS encoded FROM events")
def ledger_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.from_json("props", "k BIGINT")
    return derive.read(spark, sf_dir, "events").select("event_id", p["k"].alias("k"), F.to_json(p).alias("encoded"))


BATCH = "batch AS (SELECT DISTINCT user_id AS file_id, 'h' || (user_id % 3) AS content_hash FROM events UNION SELECT DISTINCT user_id + 1000000, 'h9' FROM events WHERE user_id % 10 = 0)"


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new batch of files: all known ones with some hash, and a tenth as many new ones."""
    users = derive.read(spark, sf_dir, "events").select("user_id").distinct()
    return users.selectExpr("user_id AS file_id", "concat('h', user_id % 3) AS content_hash").union(users.where("user_id % 10 = 0").selectExpr("user_id + 1000000", "'h9'"))


ENQUEUED = f"""WITH {LEDGER}, {BATCH}, j AS (SELECT coalesce(l.file_id, b.file_id) AS file_id, l.status, l.content_hash, l.flagged, l.error, l.created_at, l.updated_at, b.content_hash AS new,
 b.content_hash IS NULL OR coalesce(l.content_hash = b.content_hash AND l.status IN ('done', 'flagged'), false) AS stays FROM led l FULL JOIN batch b ON l.file_id = b.file_id)
SELECT file_id, CASE WHEN stays THEN status ELSE 'queued' END AS status, CASE WHEN stays THEN content_hash ELSE new END AS content_hash, coalesce(flagged, false) AS flagged, CASE WHEN stays THEN error END AS error,
 coalesce(created_at, now) AS created_at, CASE WHEN stays THEN updated_at ELSE now END AS updated_at FROM j, present"""


@query(ENQUEUED)
def ledger_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = with_now(batch(spark, sf_dir), spark, sf_dir)
    return ledger.enqueue(files(spark, sf_dir).drop("id"), new, "now")


@query(f"WITH {LEDGER}, {BATCH} SELECT b.file_id, b.content_hash, l.status FROM batch b LEFT JOIN led l USING (file_id) WHERE l.status IS NULL OR l.content_hash <> b.content_hash OR l.status NOT IN ('done', 'flagged')")
def needs_processing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.needs_processing(batch(spark, sf_dir), files(spark, sf_dir))


@query(f"WITH {LEDGER} SELECT file_id, CASE WHEN status = 'processing' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'processing' THEN '{ledger.INTERRUPTED}' ELSE error END AS error, count(*) FILTER (WHERE status = 'processing') OVER ()::BIGINT AS n_reconciled FROM led")
def reconcile_interrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    n = f.agg(F.count_if(F.col("status") == "processing").alias("n_reconciled"))
    return ledger.reconcile_interrupted(f).crossJoin(F.broadcast(n)).select("file_id", "status", "error", "n_reconciled")


@query(f"WITH {LEDGER} SELECT file_id FROM led WHERE status = 'queued'")
def queued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where("status = 'queued'").select("file_id")


@query(f"WITH {LEDGER} SELECT file_id, created_at, (epoch_us(now) - epoch_us(created_at)) / 1e6 AS elapsed_seconds FROM led, present WHERE status = 'processing' ORDER BY created_at, id")
def processing(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = with_now(files(spark, sf_dir).where("status = 'processing'"), spark, sf_dir)
    return f.orderBy("created_at", "id").select("file_id", "created_at", seconds("created_at", "now").alias("elapsed_seconds"))


@query(f"WITH {LEDGER} SELECT file_id, error, updated_at FROM led WHERE status = 'failed'")
def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where("status = 'failed'").orderBy(F.desc("updated_at"), "id").select("file_id", "error", "updated_at")


@query(f"WITH {LEDGER} SELECT file_id, status, updated_at FROM led WHERE flagged")
def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By flag, not by status: a file that failed after it was flagged stays in the report."""
    return files(spark, sf_dir).where("flagged").orderBy(F.desc("updated_at"), "id").select("file_id", "status", "updated_at")


@query(f"WITH {LEDGER} SELECT status, count(*)::BIGINT AS n FROM led GROUP BY status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n")).orderBy("status")


@query(f"WITH {LEDGER} SELECT finished, total, round(finished * 100.0 / total, 1) AS percent FROM (SELECT count(*) FILTER (WHERE status IN ('done', 'failed', 'flagged'))::BIGINT AS finished, greatest(count(*), (SELECT count(*) FROM documents))::BIGINT AS total FROM led)")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = docs(spark, sf_dir).agg(F.count(F.lit(1)).alias("inputs"))
    done = files(spark, sf_dir).agg(F.count_if(F.col("status").isin("done", "failed", "flagged")).alias("finished"), F.count(F.lit(1)).alias("known"))
    return done.crossJoin(inputs).select("finished", F.greatest("known", "inputs").alias("total")).withColumn("percent", F.round(F.col("finished") * 100.0 / F.col("total"), 1))


@query(f"WITH {LEDGER} SELECT id, file_id, status, count(*) OVER ()::BIGINT AS total FROM led WHERE status = 'done' ORDER BY id LIMIT 20 OFFSET 10")
def files_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).where("status = 'done'")
    total = f.agg(F.count(F.lit(1)).alias("total"))
    return f.select("id", "file_id", "status").orderBy("id").offset(10).limit(20).crossJoin(F.broadcast(total))


@query(f"WITH {INPUTS} SELECT doc_id, input_path FROM inputs WHERE list_last(string_split(input_path, '/')) = '8.pdf' ORDER BY doc_id LIMIT 1")
def file_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = derive.input_files(docs(spark, sf_dir))
    return f.where(T.basename(F.col("input_path")) == "8.pdf").orderBy("doc_id").limit(1).select("doc_id", "input_path")


@query(f"WITH {LEDGER} SELECT file_id, CASE WHEN status IN ('done', 'flagged') THEN 'deleted' WHEN status = 'failed' THEN 'quarantined' ELSE 'kept' END AS disposition FROM led")
def disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of the input of each file."""
    return files(spark, sf_dir).selectExpr("file_id", "CASE WHEN status IN ('done', 'flagged') THEN 'deleted' WHEN status = 'failed' THEN 'quarantined' ELSE 'kept' END AS disposition")


@query(f"WITH {INPUTS} SELECT count(*) FILTER (WHERE lower(regexp_extract(input_path, '\\.[^./]+$')) = '.pdf')::BIGINT AS submitted, count(*) FILTER (WHERE regexp_extract(input_path, '\\.[^./]+$') = '.pdf')::BIGINT AS lower_case_only FROM inputs")
def sweep_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("input_path")
    return derive.input_files(docs(spark, sf_dir)).agg(F.count_if(T.extension(p) == ".pdf").alias("submitted"), F.count_if(p.endswith(".pdf")).alias("lower_case_only"))


@query(f"""WITH {LEDGER}, {QC_CURRENT}, tot AS (SELECT min(created_at) AS started_at, max(updated_at) AS finished_at, (epoch_us(max(updated_at)) - epoch_us(min(created_at))) / 1e6 AS duration_seconds, count(*)::BIGINT AS total_files,
 count(*) FILTER (WHERE status = 'done')::BIGINT AS done_count, count(*) FILTER (WHERE status = 'failed')::BIGINT AS failed_count, count(*) FILTER (WHERE status = 'flagged')::BIGINT AS flagged_count,
 coalesce(string_agg(file_id || ':' || error, ',' ORDER BY file_id) FILTER (WHERE status = 'failed'), '') AS failed_files FROM led) SELECT tot.*, cur.*, curwins.wins FROM tot, cur, curwins""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_totals(files(spark, sf_dir)).crossJoin(current_quality(docs(spark, sf_dir)))


def ledger_totals(f: DataFrame, *keys: str) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("status") == s).alias(f"{s}_count")
    failed = F.array_sort(F.collect_list(F.when(F.col("status") == "failed", F.struct("file_id", "error"))))
    g = f.groupBy(*keys).agg(F.min("created_at").alias("started_at"), F.max("updated_at").alias("finished_at"), F.count(F.lit(1)).alias("total_files"), is_("done"), is_("failed"), is_("flagged"), F.array_join(F.transform(failed, lambda x: F.concat(x["file_id"].cast("string"), F.lit(":"), x["error"])), ",").alias("failed_files"))
    return g.where("total_files > 0").withColumn("duration_seconds", seconds("started_at", "finished_at"))


RUNS = f"""{LEDGER}, runs0 AS (SELECT id % 40 AS run_id, min(created_at) AS started_at, max(updated_at) AS finished_at, count(*)::BIGINT AS total_files, count(*) FILTER (WHERE status = 'done')::BIGINT AS done_count, count(*) FILTER (WHERE status = 'failed')::BIGINT AS failed_count,
 count(*) FILTER (WHERE status = 'flagged')::BIGINT AS flagged_count, coalesce(string_agg(file_id || ':' || error, ',' ORDER BY file_id) FILTER (WHERE status = 'failed'), '') AS failed_files FROM led GROUP BY id % 40),
runs AS (SELECT *, (epoch_us(finished_at) - epoch_us(started_at)) / 1e6 AS duration_seconds FROM runs0)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run history: the ledger in 40 runs."""
    return ledger_totals(files(spark, sf_dir).withColumn("run_id", F.col("id") % 40), "run_id")


@query(f"WITH {RUNS} SELECT * FROM runs WHERE run_id = 3")
def run_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).where("run_id = 3")


@query(f"WITH {RUNS} SELECT run_id, total_files, done_count, duration_seconds, CAST(floor(duration_seconds / 60)::BIGINT AS VARCHAR) || 'm ' || CAST(floor(duration_seconds % 60 + 0.5)::BIGINT AS VARCHAR) || 's' AS duration FROM runs ORDER BY run_id DESC LIMIT 10 OFFSET 5")
def runs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).orderBy(F.desc("run_id")).offset(5).limit(10).select("run_id", "total_files", "done_count", "duration_seconds", quality.duration(F.col("duration_seconds")).alias("duration"))


@query(f"WITH {LEDGER} SELECT file_id, (epoch_us(updated_at) - epoch_us(created_at)) / 1e6 AS seconds FROM led ORDER BY seconds DESC, file_id LIMIT 10")
def slowest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("file_id", seconds("created_at", "updated_at").alias("seconds")).orderBy(F.desc("seconds"), "file_id").limit(10)
