"""Line dedup by site-relative frequency (operator 10).

For each host the pages that contain a line are divided by the host's pages.  A line on at least
``min_pages`` pages and more than ``ratio`` of them is boilerplate, and all its occurrences on that
host are dropped.  A line counts once per page; lines without a word character never count and are
kept.  A null text has no lines and stays null; a null host is a host of its own.  Rows without an id and
repeated rows are pages as any other.  A line on exactly the ratio stays.

Lines are compared by two independent hashes, of 64 and 32 bits; the lines of a page meet the list of its
host once by hash, and only the keys found there are compared with each line.  A host of P pages with L lines a page has at
most L / ratio boilerplate lines, so the list per host is bounded by the ratio, not by its pages.
The join on the host is salted on the document side; the list of hosts is broadcast only when its
measured size is under ``broadcast_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import fresh, keep

SALTS = 64


def line_key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line, F.length(line)).alias("b"))


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def boilerplate_lines(docs: DataFrame, host: Column, text: Column, ratio: float, min_pages: int) -> DataFrame:
    """(host, keys): the boilerplate lines of each host that has any.

    Pages are counted in the same pass as lines: each page adds one row of a null key.  Partial
    aggregation runs before the shuffle, so a line on every page of a hot host travels once per task.
    """
    keys = F.array_distinct(F.transform(F.filter(F.split(text, "\n"), has_word), line_key))
    null_key = F.lit(None).cast("struct<a:bigint,b:int>")
    counted = docs.select(host.alias("host"), F.explode(F.concat(F.coalesce(keys, F.array().cast("array<struct<a:bigint,b:int>>")), F.array(null_key))).alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    lines = counted.where(F.col("key").isNotNull() & (F.col("n") >= min_pages))
    pages = counted.where(F.col("key").isNull()).select(F.col("host").alias("h"), F.col("n").alias("pages"))
    return lines.join(pages, lines.host.eqNullSafe(pages.h)).where(F.col("n") > ratio * F.col("pages")).groupBy("host").agg(F.collect_list("key").alias("keys"))


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.02, min_pages: int = 5, broadcast_lines: int = 100_000, n_lines: str = "_n_lines", n_dropped: str = "_n_dropped") -> DataFrame:
    """``docs`` with the boilerplate lines gone, and columns added that count the lines and those dropped.

    A column of ``docs`` that has the name of an added one is replaced; all others stay as they are.
    """
    host, keys, salt, salt_l, lines, found, hits, kept = fresh(docs, "_host", "_keys", "_salt", "_salt_l", "_lines", "_found", "_hits", "_kept")
    bad = boilerplate_lines(docs, F.col(host_col), F.col(text_col), ratio, min_pages).select(F.col("host").alias(host), F.col("keys").alias(keys))
    bad = keep(bad, "boilerplate")
    total = bad.agg(F.coalesce(F.sum(F.size(keys)), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("h")).first()
    if total.n + total.h <= broadcast_lines:
        joined = docs.join(F.broadcast(bad), docs[host_col].eqNullSafe(bad[host]), "left")
    else:
        salted = bad.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = docs.withColumn(salt_l, F.pmod(F.xxhash64(*[F.col(c) for c in docs.columns if c != host_col] or [F.lit(0)]), F.lit(SALTS)).cast("int"))
        joined = left.join(salted, left[host_col].eqNullSafe(salted[host]) & (left[salt_l] == salted[salt]), "left")
    # Each step is a column of its own, used twice by the next: Spark then keeps it, instead of working it out again for each line.
    split = joined.withColumn(lines, F.split(F.col(text_col), "\n"))
    met = F.array_intersect(F.transform(lines, lambda x: F.xxhash64(x)), F.transform(keys, lambda k: k["a"]))
    split = split.withColumn(found, met)
    split = split.withColumn(hits, F.when(F.size(found) > 0, F.filter(keys, lambda k: F.array_contains(F.col(found), k["a"]))))
    split = split.withColumn(kept, F.when(F.size(hits) > 0, F.filter(lines, lambda x: ~F.array_contains(F.col(hits), line_key(x)) | ~has_word(x))).otherwise(F.col(lines)))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    text = F.when(F.size(hits) > 0, F.array_join(kept, "\n")).otherwise(F.col(text_col))
    own = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in (n_lines, n_dropped)]
    return split.select(*own, size(lines).alias(n_lines), (size(lines) - size(kept)).alias(n_dropped))


ORACLE = r"""
WITH lines AS (SELECT doc_id, source, pos, line FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
seen AS (SELECT source, line, count(DISTINCT doc_id) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY source, line),
pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
bad AS (SELECT s.source, s.line FROM seen s JOIN pages p ON s.source IS NOT DISTINCT FROM p.source WHERE n >= 5 AND n > 0.02 * pages),
marked AS (SELECT l.*, b.line IS NOT NULL AS dropped FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '') AS text
FROM marked GROUP BY doc_id
"""
