"""Queries on language, history, recognizers and sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import recognizers
from ..functions import text as T
from ..operators import language, sketches
from ..operators.asof import asof
from . import derive
from .corpus_queries import KNOWN, corpus_metrics, docs
from .ledger_queries import EVENTS, LEDGER, events, files, seconds
from .registry import ORACLES, query

LANGUAGES = ["de", "en", "es", "fr"]
_EACH = lambda form, joint=", ": joint.join(form(x) for x in LANGUAGES)

DETECT = rf"""t0 AS (SELECT doc_id, lang, length(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) < 8 AS short,
 string_split(' ' || regexp_replace(translate(coalesce(text, ''), '{language.UPPER}', '{language.LOWER}'), '[\x00-\x60\x7B-\x7F]+', ' ', 'g') || ' ', '') AS c FROM documents),
g AS (SELECT doc_id, lang, short, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram FROM t0),
n AS (SELECT lang, gram, count(*) AS n FROM g WHERE doc_id % 5 <> 0 AND lang IN ({_EACH(lambda x: f"'{x}'")}) GROUP BY lang, gram),
chosen AS (SELECT DISTINCT gram FROM n QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) <= 500),
own AS (SELECT gram, {_EACH(lambda x: f"coalesce(max(n) FILTER (WHERE lang = '{x}'), 0) AS {x}")} FROM n SEMI JOIN chosen USING (gram) GROUP BY gram),
sums AS (SELECT count(*) AS v, {_EACH(lambda x: f"sum({x}) AS s_{x}")} FROM own),
w AS (SELECT gram, {_EACH(lambda x: f"ln(({x} + 0.5::DOUBLE) / (s_{x} + 0.5::DOUBLE * v)) AS {x}")} FROM own, sums),
sc AS (SELECT doc_id, any_value(short) AS short, {_EACH(lambda x: f"coalesce(sum({x}), 0.0::DOUBLE) AS {x}")} FROM t0 LEFT JOIN g USING (doc_id, lang, short) LEFT JOIN w USING (gram) GROUP BY doc_id),
pr AS (SELECT doc_id, short, {_EACH(lambda x: f"round(1 / ({_EACH(lambda y: f'exp(least({y} - {x}, 700.0))', ' + ')}), 6) AS p_{x}")} FROM sc),
un AS (SELECT doc_id, short, list_sort([{_EACH(lambda x: f"{{'p': -p_{x}, 'l': '{x}'}}")}]) AS found FROM pr)"""


@query(rf"""WITH {DETECT}, co AS (SELECT *, list_filter(list_transform(list_filter(found, lambda f: -f.p >= 0.15), lambda f: CASE f.l WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'fr' THEN 'fra' ELSE f.l END), lambda x: x IN ('eng', 'deu', 'fra')) AS codes FROM un)
SELECT doc_id, doc_id % 5 = 0 AS held_out, found[1].l AS language, -found[1].p AS prob, CASE WHEN short OR len(codes) = 0 THEN 'eng,deu,fra' ELSE array_to_string(codes, ',') END AS languages FROM co""")
def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all texts by trigrams of four fifths of them."""
    d = docs(spark, sf_dir)
    profile = language.fit(d.where("doc_id % 5 <> 0"), LANGUAGES)
    found = language.detect(d, profile, LANGUAGES, KNOWN)
    return found.select("doc_id", (F.col("doc_id") % 5 == 0).alias("held_out"), "language", F.col("detected")[0]["prob"].alias("prob"), F.array_join("languages", ",").alias("languages"))


@query(f"""WITH {EVENTS}, q AS (SELECT file_id, ts, event_id, content_hash FROM fe WHERE op = 'enqueue')
SELECT f.file_id, f.event_id, f.ts, q.event_id AS queued_by, q.content_hash AS queued_hash FROM (SELECT * FROM fe WHERE op = 'failed') f ASOF LEFT JOIN q ON f.file_id = q.file_id AND f.ts >= q.ts""")
def state_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each failure had been queued by, and with which content, at its time."""
    e = events(spark, sf_dir)
    queued = e.where("op = 'enqueue'").select("file_id", "ts", F.col("event_id").alias("queued_by"), F.col("content_hash").alias("queued_hash"))
    return asof(e.where("op = 'failed'").select("file_id", "event_id", "ts"), queued, "file_id", "ts", ["queued_by", "queued_hash"])


@query("""WITH w AS (SELECT doc_id, text, unnest(list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> '')) AS word FROM documents WHERE length(text) % 10 <> 0)
SELECT doc_id AS page_id, count(*)::BIGINT AS n_words, sum(100 - length(word) % 41)::DOUBLE AS confidence, max(length(word))::BIGINT AS longest FROM w GROUP BY doc_id""")
def recognize_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through a table function in SQL, by a recognizer that fails on some of them."""
    recognizers.register(spark)
    docs(spark, sf_dir).selectExpr("doc_id AS page_id", "text").createOrReplaceTempView("quire_pages")
    return spark.sql("SELECT page_id, count(1) AS n_words, sum(confidence) AS confidence, CAST(max(length(text)) AS BIGINT) AS longest FROM recognize(TABLE(SELECT page_id, text FROM quire_pages), 'brittle', 16) GROUP BY page_id")


SKETCHED = "wd AS (SELECT lang, source, unnest(list_filter(regexp_split_to_array(text, '[\x09-\x0d\x20]+'), lambda x: x <> '')) AS word FROM documents)"


@query(f"WITH {SKETCHED} SELECT lang, count(*)::BIGINT AS n, count(DISTINCT word)::BIGINT AS n_distinct, true AS distinct_holds, true AS quantiles_hold FROM wd GROUP BY lang")
def sketch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and their lengths sketched by language and source, rolled up to languages, and held against the exact values.

    The bounds are five deviations: 4 % of the distinct count, and 2 % of the rank of each quartile.
    """
    words = docs(spark, sf_dir).select("lang", "source", F.explode(T.tokens(F.col("text"))).alias("word"))
    length = F.length("word").cast("long")
    rolled = sketches.rolled_up(sketches.sketched(words, ["lang", "source"], F.col("word"), length), ["lang"])
    quartiles = [sketches.quantile(q).alias(f"q{i}") for i, q in enumerate((0.25, 0.5, 0.75))]
    approx = rolled.select("lang", "n", sketches.n_distinct().alias("about"), *quartiles)
    met = words.join(F.broadcast(approx.drop("n", "about")), "lang")
    ranks = [F.avg((length < F.col(f"q{i}")).cast("double")).alias(f"under{i}") for i in range(3)] + [F.avg((length <= F.col(f"q{i}")).cast("double")).alias(f"upto{i}") for i in range(3)]
    exact = met.groupBy("lang").agg(F.count_distinct("word").alias("n_distinct"), *ranks)
    holds = lambda i, q: (F.col(f"under{i}") <= q + 0.02) & (F.col(f"upto{i}") >= q - 0.02)
    j = approx.join(exact, "lang")
    return j.select("lang", "n", "n_distinct", (F.abs(F.col("about") - F.col("n_distinct")) <= F.greatest(F.lit(1), F.col("n_distinct") * 0.04)).alias("distinct_holds"), (holds(0, 0.25) & holds(1, 0.5) & holds(2, 0.75)).alias("quantiles_hold"))


@query(f"""WITH {LEDGER}, folders AS (SELECT substr(sha1('/in/' || user_id || '.pdf'), 1, 16) AS folder FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT substr(sha1('/in/gone-' || user_id || '.pdf'), 1, 16) FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 5 = 0)),
live AS (SELECT substr(sha1('/in/' || file_id || '.pdf'), 1, 16) AS folder FROM led WHERE status IN ('queued', 'processing')) SELECT folder FROM folders ANTI JOIN live USING (folder)""")
def orphan_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work folders at startup that belong to no file that waits or is at work."""
    users = derive.read(spark, sf_dir, "events").select("user_id").distinct()
    path = lambda form, c: T.staging_key(F.format_string(form, c)).alias("folder")
    folders = users.select(path("/in/%d.pdf", "user_id")).union(users.where("user_id % 5 = 0").select(path("/in/gone-%d.pdf", "user_id")))
    live = files(spark, sf_dir).where("status IN ('queued', 'processing')").select(path("/in/%d.pdf", "file_id"))
    return folders.join(live, "folder", "left_anti")


@query(f"""WITH {LEDGER}, m AS ({ORACLES["corpus_metrics"]}), s AS (SELECT round(avg((epoch_us(updated_at) - epoch_us(created_at)) / 1e6) FILTER (WHERE status IN ('done', 'flagged')), 4) AS mean_seconds, count(*) FILTER (WHERE status IN ('done', 'flagged'))::BIGINT AS n_timed FROM led)
SELECT m.*, s.mean_seconds, s.n_timed FROM m, s""")
def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of the corpus with the mean time from queue to result of the files that came through."""
    through = F.col("status").isin("done", "flagged")
    took = files(spark, sf_dir).agg(F.round(F.avg(F.when(through, seconds("created_at", "updated_at"))), 4).alias("mean_seconds"), F.count_if(through).alias("n_timed"))
    return corpus_metrics(spark, sf_dir).crossJoin(F.broadcast(took))
