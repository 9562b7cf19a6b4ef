"""File sources and sinks: recursive scans, hot folders, sidecars and staged pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension
from ..operators.numbering import numbered
from ..storage import keep

BINARY = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
SIDECAR = "passthrough BOOLEAN, pages ARRAY<STRUCT<page_no: INT, flagged: BOOLEAN>>, mean_confidence DOUBLE, engine_win_counts MAP<STRING, BIGINT>"
STAGED = "blocks ARRAY<STRUCT<kind: STRING, text: STRING, html: STRING, image: STRING>>"


def scan(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """Regular files below a root whose suffix, in any case, is one of ``extensions``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.where(extension(F.col("path")).isin(*[e.lower() for e in extensions]))


def hashed(files: DataFrame) -> DataFrame:
    return files.select("path", "modificationTime", "length", F.sha2("content", 256).alias("content_hash"))


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files not known at their time of modification: what a stream of new paths misses."""
    return files.join(known.select("path", "modificationTime"), ["path", "modificationTime"], "left_anti")


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(change, path, from_path): what has become of the files of one listing (path, content_hash) in the next.

    ``created``, ``modified`` (same path, other content), ``deleted``, and ``moved`` (a path that is gone and a new
    one of the same content).  Of equal contents the k-th path gone goes with the k-th new one, in order of the paths, and
    what is left over is deleted or created.  Files that stay are left out.  A path counts once in a listing; a content
    that cannot be read (null hash) moves nowhere, and is modified if only one side has it.  Ranks are taken over
    ranges of paths, so a content that very many files share, such as that of empty ones, is not one task.
    """
    old, new = (df.groupBy("path").agg(F.max("content_hash").alias(h)) for df, h in ((before, "_old"), (now, "_new")))
    mark = lambda df: df.withColumn("_here", F.lit(True))
    both = mark(old).withColumnRenamed("_here", "_was").join(mark(new).withColumnRenamed("_here", "_is"), "path", "full_outer").where(F.col("_was").isNull() | F.col("_is").isNull() | ~F.col("_old").eqNullSafe(F.col("_new")))
    both = keep(both, "tree")
    same = both.where("_was AND _is").select(F.lit("modified").alias("change"), "path", F.lit(None).cast("string").alias("from_path"))
    gone = both.where("_is IS NULL").select("path", F.col("_old").alias("hash"), F.lit(0).alias("side"))
    come = both.where("_was IS NULL").select("path", F.col("_new").alias("hash"), F.lit(1).alias("side"))
    ranked = keep(numbered(gone.unionByName(come), ["side", "hash"], ["path"], "k"), "ranked")
    a = ranked.where("side = 0").select(F.col("path").alias("from_path"), "hash", "k")
    b = ranked.where("side = 1").select("path", "hash", "k")
    met = a.join(b, ["hash", "k"], "full_outer")
    change = F.when(F.col("path").isNull(), "deleted").when(F.col("from_path").isNull(), "created").otherwise("moved")
    return same.unionByName(met.select(change.alias("change"), F.coalesce("path", "from_path").alias("path"), F.when(F.col("path").isNotNull(), F.col("from_path")).alias("from_path")))


def once(files: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of files (path, content_hash, modificationTime, ...) without those seen less than ``delay`` before, by path and content.

    State goes at the end of a batch, with the watermark of modification times, so it holds the files of about the last
    ``delay``; a file that comes again after it has gone passes, and the ledger decides then whether anything is to be done.
    The rows of a batch come in any order, so the earliest of equal path and content goes ahead of the others; a task
    holds its part of one batch for that.
    """
    keys = ["path", "content_hash"]
    dealt = files.repartition(*keys).mapInArrow(earliest, files.schema)
    return dealt.withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(keys)


def earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row by modificationTime of each path and content."""
    rows = list(batches)
    if not rows:
        return
    t = pa.Table.from_batches(rows)
    keys = [(c, "ascending") for c in ("path", "content_hash", "modificationTime")]
    t = t.take(pc.sort_indices(t, sort_keys=keys)).combine_chunks()
    new = np.ones(t.num_rows, bool)
    if t.num_rows > 1:
        new[1:] = False
        for c in ("path", "content_hash"):
            x, y = (t.column(c).slice(a, t.num_rows - 1) for a in (1, 0))
            other = pc.fill_null(pc.not_equal(x, y), False).to_numpy(zero_copy_only=False)
            new[1:] |= other | (x.is_null().to_numpy(zero_copy_only=False) != y.is_null().to_numpy(zero_copy_only=False))
    yield from t.filter(pa.array(new)).combine_chunks().to_batches()


def watch(spark: SparkSession, root: str, extensions: list[str], files_per_trigger: int = 1000) -> DataFrame:
    """A stream of new files: backlog and arrivals in one listing."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).load(root)
    return files.where(extension(F.col("path")).isin(*[e.lower() for e in extensions]))


def sidecars(spark: SparkSession, root: str, pattern: str = "*.qc.json", whole: bool = True) -> DataFrame:
    """Quality sidecars below a root, corrupt ones left out, with their route; one record a file, or one a line."""
    rows = spark.read.schema(SIDECAR).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("multiLine", whole).option("mode", "DROPMALFORMED").json(root)
    empty = F.coalesce(F.size("pages"), F.lit(0)) <= 0
    return rows.withColumn("route", F.when(F.coalesce("passthrough", F.lit(False)), "passthrough").when(empty, "skip_text").otherwise("ocr"))


def write_staged(blocks: DataFrame, folder: str, broken: Column | None = None) -> None:
    """Blocks (doc_id, region_id, kind, text, html, image) as one JSON record a page, named by its padded number; ``broken`` cuts records off."""
    page = F.transform(F.array_sort(F.collect_list(F.struct("region_id", "kind", "text", "html", "image"))), lambda b: F.struct(*[b[c].alias(c) for c in ("kind", "text", "html", "image")]))
    name = F.concat(F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".page.json"))
    rows = blocks.groupBy("doc_id").agg(page.alias("blocks")).select("doc_id", F.to_json(F.struct(name.alias("name"), "blocks")).alias("value"))
    if broken is not None:
        rows = rows.withColumn("value", F.when(broken, F.expr("substring(value, 1, length(value) div 2)")).otherwise(F.col("value")))
    rows.select("value").write.text(folder)


def staged_pages(spark: SparkSession, folder: str, whole: bool = True) -> DataFrame:
    """(name, blocks) of staged pages, corrupt ones and those without blocks left out; one page a file, or one a line with its name."""
    if not whole:
        rows = spark.read.schema(f"name STRING, {STAGED}").option("mode", "DROPMALFORMED").json(folder)
        return rows.where("name IS NOT NULL AND blocks IS NOT NULL")
    rows = spark.read.schema(STAGED).option("pathGlobFilter", "*.page.json").option("multiLine", True).option("mode", "DROPMALFORMED").json(folder)
    return rows.where("blocks IS NOT NULL").select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), "blocks")


def write_sidecars(summaries: DataFrame, root: str) -> None:
    """Summaries as JSON, one folder per route."""
    summaries.write.mode("append").partitionBy("route").json(root)


def write_records(records: DataFrame, root: str | None, by: str) -> None:
    """Quality records of pages, or a run of the history, appended below a root as JSON, one folder per value; nothing without a root."""
    if root is not None:
        records.write.mode("append").partitionBy(by).json(root)


def records(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """What ``write_records`` has appended."""
    return spark.read.schema(schema).json(root)
