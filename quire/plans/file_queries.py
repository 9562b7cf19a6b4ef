"""Queries that write files to the shared folder and read them back by the file sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from ..storage import scratch
from ..streaming.runs import drained
from . import derive
from .corpus_queries import FILE_SANE, ROUTE, docs, file_sanity, page_records
from .ledger_queries import RUNS, runs
from .page_queries import BLOCKS, block_rows
from .registry import RECONCILED, query

TREE = "SELECT lang, source, sum(strlen(text) + 1)::BIGINT AS bytes FROM documents GROUP BY lang, source"


def tree(spark: SparkSession, sf_dir: str) -> str:
    """Texts as files below folders by language and source, beside files of another suffix."""
    root = f"{scratch(spark)}/in"
    d = docs(spark, sf_dir)
    d.select("lang", "source", "text").write.option("lineSep", "\n").partitionBy("lang", "source").text(root)
    d.select("doc_id").write.json(f"{root}/lang=other/source=other")
    return root


def sizes(found: DataFrame) -> DataFrame:
    part = lambda name: F.regexp_extract("path", f"/{name}=([^/]*)/", 1).alias(name)
    return found.groupBy(part("lang"), part("source")).agg(F.sum("length").alias("bytes"))


@query(TREE)
def scan_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one suffix, in any case, below a root."""
    return sizes(files.scan(spark, tree(spark, sf_dir), [".TXT"]).select("path", "length"))


@query(TREE)
def watch_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream of new files, a few at a time."""
    found = files.watch(spark, tree(spark, sf_dir), [".txt"], files_per_trigger=50).select("path", "length")
    return sizes(drained(found, scratch(spark)))


@query(f"WITH {FILE_SANE} SELECT {ROUTE} AS route, count(*)::BIGINT AS n, sum(n_pages)::BIGINT AS n_pages FROM fs GROUP BY 1")
def sidecar_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecars written by route and read back, their route found again from what they hold."""
    root = f"{scratch(spark)}/qc"
    pages = F.when(F.col("n_pages") > 0, F.transform(F.sequence(F.lit(0), F.col("n_pages").cast("int") - 1), lambda p: F.struct(p.alias("page_no"), F.lit(False).alias("flagged"))))
    summary = file_sanity(docs(spark, sf_dir)).select(F.expr(ROUTE).alias("route"), F.col("all_sane").alias("passthrough"), pages.alias("pages"))
    files.write_sidecars(summary, root)
    return files.sidecars(spark, root, "*.json", whole=False).groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.size("pages"), F.lit(0)).cast("long")).alias("n_pages"))


@query(f"WITH {RECONCILED} SELECT lang, layout_type, count(*)::BIGINT AS n, sum(n_words)::BIGINT AS n_words, count(*) FILTER (WHERE flagged)::BIGINT AS n_flagged FROM pageqc GROUP BY lang, layout_type")
def page_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page records appended to a folder by language, and summed up from there."""
    root = f"{scratch(spark)}/pages"
    files.write_records(page_records(docs(spark, sf_dir)).select("doc_id", "lang", "layout_type", "n_words", "flagged"), root, "lang")
    back = files.records(spark, root, "doc_id BIGINT, layout_type STRING, n_words BIGINT, flagged BOOLEAN, lang STRING")
    return back.groupBy("lang", "layout_type").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("n_words"), F.count_if("flagged").alias("n_flagged"))


@query(f"WITH {RUNS} SELECT run_id, total_files, failed_count, failed_files FROM runs WHERE run_id IN (3, 4)")
def history_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs appended to the history one after the other."""
    root = f"{scratch(spark)}/history"
    for k in (3, 4):
        files.write_records(runs(spark, sf_dir).where(F.col("run_id") == k).select("run_id", "total_files", "failed_count", "failed_files"), root, "run_id")
    return files.records(spark, root, "run_id BIGINT, total_files BIGINT, failed_count BIGINT, failed_files STRING")


@query("SELECT doc_id, to_base64(encode(text)) AS content FROM documents")
def content_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes as a model's request carries them."""
    return docs(spark, sf_dir).select("doc_id", F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "[\\r\\n]", "").alias("content"))



TREES = """f AS (SELECT lang, source, doc_id // 5000 AS part, string_agg(text || chr(10), '' ORDER BY doc_id) AS c, string_agg(text || '!' || chr(10), '' ORDER BY doc_id) AS c1, string_agg(text || '?' || chr(10), '' ORDER BY doc_id) AS c2 FROM documents GROUP BY ALL),
old AS (SELECT 'lang=' || lang || '/source=' || source || '/part=' || part AS path, c FROM f),
new AS (SELECT 'lang=' || lang || '/source=' || source || '/part=' || part AS path, CASE WHEN lang = 'en' AND CAST(substr(source, 4) AS INT) % 2 = 0 THEN c1 ELSE c END AS c FROM f WHERE lang NOT IN ('de', 'fr')
 UNION ALL SELECT 'lang=neu/source=' || source || '/part=' || part, c FROM f WHERE lang = 'de' UNION ALL SELECT 'lang=kopie/source=' || source || '/part=' || part, c2 FROM f WHERE lang = 'es'),
j AS (SELECT coalesce(o.path, n.path) AS path, o.c AS oc, n.c AS nc, o.path IS NOT NULL AS was, n.path IS NOT NULL AS here FROM old o FULL JOIN new n ON o.path = n.path),
gone AS (SELECT path, oc AS c, row_number() OVER (PARTITION BY oc ORDER BY path) AS k FROM j WHERE NOT here), come AS (SELECT path, nc AS c, row_number() OVER (PARTITION BY nc ORDER BY path) AS k FROM j WHERE NOT was)"""


@query(f"""WITH {TREES} SELECT 'modified' AS change, path, NULL AS from_path FROM j WHERE was AND here AND oc <> nc
UNION ALL SELECT CASE WHEN c.path IS NULL THEN 'deleted' WHEN g.path IS NULL THEN 'created' ELSE 'moved' END, coalesce(c.path, g.path), CASE WHEN c.path IS NOT NULL THEN g.path END FROM gone g FULL JOIN come c ON g.c = c.c AND g.k = c.k""")
def tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of a folder: some files with more text, some in another folder, some gone, some new."""
    top = scratch(spark, "trees")
    d = docs(spark, sf_dir).select("doc_id", "lang", "source", "text", F.floor(F.col("doc_id") / 5000).alias("part"))
    with_end = lambda df, end, lang=F.col("lang"): df.withColumns({"text": F.concat("text", F.lit(end)), "lang": lang})
    more = (F.col("lang") == "en") & (F.substring("source", 4, 9).cast("int") % 2 == 0)
    changed = d.where("lang NOT IN ('de', 'fr')").withColumn("text", F.when(more, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    later = changed.union(with_end(d.where("lang = 'de'"), "", F.lit("neu"))).union(with_end(d.where("lang = 'es'"), "?", F.lit("kopie")))
    listed = []
    for name, rows in (("before", d), ("now", later)):
        folder = ["lang", "source", "part"]
        rows.repartition(*folder).sortWithinPartitions(*folder, "doc_id").select(*folder, "text").write.option("lineSep", "\n").partitionBy(*folder).text(f"{top}/{name}")
        found = files.hashed(files.scan(spark, f"{top}/{name}", [".txt"]))
        listed.append(found.select(F.regexp_extract("path", "/(lang=.*)/[^/]*$", 1).alias("path"), "content_hash"))
    return files.changes(*listed)


@query(f"WITH {BLOCKS}, pg AS (SELECT doc_id, count(*)::BIGINT AS n_blocks, string_agg(text, chr(10) ORDER BY region_id) FILTER (WHERE text <> '') AS text FROM bl WHERE doc_id % 5 <> 0 GROUP BY doc_id) SELECT doc_id, n_blocks, coalesce(text, '') AS text FROM pg")
def staged_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of pages staged as JSON, every fifth page cut off in the middle, and read back in page order."""
    folder = scratch(spark, "staged")
    files.write_staged(block_rows(docs(spark, sf_dir)), folder, broken=F.col("doc_id") % 5 == 0)
    back = files.staged_pages(spark, folder, whole=False)
    text = F.array_join(F.transform(F.filter("blocks", lambda b: b["text"] != ""), lambda b: b["text"]), "\n")
    return back.select(F.regexp_extract("name", "[0-9]+", 0).cast("long").alias("doc_id"), F.size("blocks").cast("long").alias("n_blocks"), text.alias("text"))
