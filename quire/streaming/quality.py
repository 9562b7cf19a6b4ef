"""Live quality totals: sums that are folded batch by batch, never worked out anew.

Each record is the last word on its file, so a batch adds what its records say and takes away what the files'
earlier records said.  Confidence is summed in decimals, so adding and taking away in any order is exact.  The
records of a batch's files are looked up in the buckets they fall in; all others are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.quality import ENGINES
from .table import KeyedTable

ROUTES = ("passthrough", "skip_text", "ocr")
RECORD = "doc_id BIGINT, source STRING, seq BIGINT, route STRING, mean_confidence DECIMAL(18,9), wins_primary BIGINT, wins_secondary BIGINT"
SUMS = [*(f"{r}_count" for r in ROUTES), "n_mean", *(f"wins_{e}" for e in ENGINES)]
TOTAL = f"source STRING, {', '.join(f'{c} BIGINT' for c in SUMS)}, sum_mean DECIMAL(38,9)"


def records_table(spark: SparkSession, folder: str, buckets: int) -> KeyedTable:
    return KeyedTable(spark, f"{folder}/records", RECORD, "doc_id", buckets)


def totals_table(spark: SparkSession, folder: str) -> KeyedTable:
    return KeyedTable(spark, f"{folder}/totals", TOTAL, "source", 4)


def partial(records: DataFrame, sign: int = 1) -> DataFrame:
    """What records add to the totals of their source, or take away."""
    ocr = F.col("route") == "ocr"
    counts = [(F.count_if(F.col("route") == r) * sign).alias(f"{r}_count") for r in ROUTES]
    only: Column = F.when(ocr, F.col("mean_confidence"))
    wins = [(F.coalesce(F.sum(F.when(ocr, F.col(f"wins_{e}"))), F.lit(0)) * sign).alias(f"wins_{e}") for e in ENGINES]
    total = F.coalesce(F.sum(only), F.lit(0)).cast("decimal(38,9)")
    return records.groupBy("source").agg(*counts, (F.count(only) * sign).alias("n_mean"), *wins, (total if sign > 0 else -total).alias("sum_mean"))


def summed(partials: DataFrame) -> DataFrame:
    return partials.groupBy("source").agg(*[F.sum(c).alias(c) for c in SUMS], F.sum("sum_mean").cast("decimal(38,9)").alias("sum_mean"))


def folding(records: DataFrame, folder: str, buckets: int = 64) -> StreamingQuery:
    """Starts the stream that folds records into totals until its source is empty.

    Of several records of a file the one of greatest ``seq`` holds, whichever comes first.  A batch replayed after
    a failure reads both tables as they were before it.
    """
    spark = records.sparkSession
    kept, totals = records_table(spark, folder, buckets), totals_table(spark, folder)
    columns = [c.split()[0] for c in RECORD.split(", ")]

    def put(batch: DataFrame, number: int) -> None:
        last = batch.withColumn("mean_confidence", F.col("mean_confidence").cast("decimal(18,9)")).groupBy("doc_id").agg(F.max_by(F.struct(*columns[1:]), "seq").alias("r")).select("doc_id", "r.*")
        before = kept.of(last, number).persist()
        old = before.select("doc_id", F.col("seq").alias("_seq"))
        changed = last.join(old, "doc_id", "left").where("_seq IS NULL OR _seq < seq").drop("_seq").persist()
        delta = partial(changed).unionByName(partial(before.join(changed, "doc_id", "left_semi"), -1))
        now = summed(totals.of(delta, number).select(*delta.columns).unionByName(delta))
        totals.merge(now, number + 1)
        kept.merge(changed, number + 1)
        for table in (totals, kept):
            table.prune()
        before.unpersist()
        changed.unpersist()

    return records.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/quality-checkpoint").trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """One row: files by route, mean confidence and wins of the recognized ones, from the totals of the sources."""
    g = totals_table(spark, folder).read().agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS], F.sum("sum_mean").alias("sum_mean"))
    wins = F.concat_ws(",", *[F.when(F.col(f"wins_{e}") > 0, F.concat(F.lit(f"{e}:"), F.col(f"wins_{e}").cast("string"))) for e in ENGINES])
    mean = F.round(F.col("sum_mean").cast("double") / F.nullif(F.col("n_mean"), F.lit(0)), 6)
    return g.select(*[f"{r}_count" for r in ROUTES], mean.alias("mean_confidence"), F.nullif(wins, F.lit("")).alias("wins"))
