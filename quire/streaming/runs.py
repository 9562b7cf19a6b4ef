"""Running streams: staged input, draining to a table, stopping between batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import storage

ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def with_rocks(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, which keyed state with timers needs."""
    before = spark.conf.get(ROCKS[0], None)
    spark.conf.set(*ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(ROCKS[0])
        else:
            spark.conf.set(ROCKS[0], before)


def staged(rows: DataFrame, slot: str, slots: int, folder: str) -> DataFrame:
    """The rows as a stream of ``slots`` files, one a batch in the order of the column ``slot``, which goes.

    Rows are shuffled into their file: without that, one task would read the whole input for each.
    """
    for k in range(slots):
        rows.where(F.col(slot) == k).drop(slot).repartition(1).write.mode("append").parquet(folder)
    return arriving(rows.sparkSession, folder, rows.drop(slot))


def arriving(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All rows that a stream yields until its source is empty, through a table in ``folder``; in complete mode its last result."""
    schema = stream.schema

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={0 if mode == 'complete' else number}")

    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    if not storage.names(spark, f"{folder}/out"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{folder}/out").parquet(f"{folder}/out").select(*schema.names)


def batch_number(query: StreamingQuery) -> int:
    """The last batch that is done, -1 before the first."""
    last = query.lastProgress
    return -1 if last is None else int(last["batchId"])


def run_until(query: StreamingQuery, stop: Callable[[], bool], poll_seconds: float = 0.5) -> bool:
    """Waits for a stream to end, or ends it once ``stop`` says so and the batch of that moment is done; whether it was ended.

    Later batches are not waited for, so it ends under steady arrivals too.  What is cut off runs again at the next start.
    """
    while query.isActive:
        if stop():
            done = batch_number(query)
            while query.isActive and query.status["isTriggerActive"] and batch_number(query) == done:
                query.awaitTermination(poll_seconds)
            query.stop()
            return True
        query.awaitTermination(poll_seconds)
    return False
