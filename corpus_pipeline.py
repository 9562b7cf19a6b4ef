"""A training-corpus pipeline over ``documents``: each stage reads what the one before it kept.

Quality rules, site-relative line dedup, n-gram Jaccard dedup, redaction of personal data, and
best-fit packing.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import jaccard, lines, packing, pii, quality
from quire.llm.store import keep

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.filter_quality(docs.select(*COLUMNS))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their site.

    A document that had lines with a word, all of them boilerplate, is a copy of other pages of its site: of
    those that agree in their lines with a word, one keeps its whole text, the one of least id, and the
    others go.  Rows without an id come last.  A document without any word stays as it is.
    """
    own = docs.select(*COLUMNS).withColumn("whole", F.col("text"))
    cut = lines.drop_boilerplate(own, n_lines="n_lines", n_dropped="n_dropped").withColumn("emptied", (F.col("n_dropped") > 0) & ~lines.has_word(F.col("text")))
    # Kept, since a filter on the result would be moved in front of the steps that make it and repeat them for each line.
    cut = keep(cut.select("doc_id", "text", "lang", "source", "emptied", F.when(F.col("emptied"), F.col("whole")).alias("whole")), "lines")
    copies = cut.where("emptied").select("doc_id", F.col("whole").alias("text"), "lang", "source")
    page = F.array_join(F.filter(F.split("text", "\n"), lines.has_word), "\n")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text", "lang")).alias("one")
    ones = copies.groupBy("source", lines.line_key(page).alias("page")).agg(least).select("one.doc_id", "one.text", "one.lang", "source")
    return _counted(cut.where("NOT coalesce(emptied, false)").select(*ones.columns).union(ones))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of linked documents; rows without an id come last, those without words all stay."""
    return jaccard.first_of_each(docs.select(*COLUMNS))


def redaction_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return _counted(pii.redact(docs.select(*COLUMNS)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its bin."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", near_duplicate_stage),
    ("redaction", redaction_stage),
    ("packing", packing_stage),
]

#: zstandard, CRF and best-fit packing have no SQL form; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
