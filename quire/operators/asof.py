"""As-of join: for each row the last row of another table at or before its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: str, time: str, columns: list[str], bucket_seconds: int = 86_400) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` of the same key whose time is not after; nulls where there is none.

    Rows of both sides are put in one order of time within (key, bucket of time), and the last value of the right side
    is carried on.  What a bucket begins with comes from a small table, the last right row of each bucket carried over the
    buckets before.  So there is no range join, and a key with very many rows is spread over its buckets.  Rows of
    ``left`` without key or time keep nulls; of right rows of one time, that of greatest columns holds.
    """
    value = F.struct(*columns)
    bucket = F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / bucket_seconds).alias("_b")
    a = left.select(F.struct(*left.columns).alias("_row"), F.col(key).alias("_k"), F.col(time).alias("_t"), bucket, F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_v"), F.lit(1).alias("_side"))
    b = right.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(key).alias("_k"), F.col(time).alias("_t"), bucket, value.alias("_v"), F.lit(0).alias("_side"))
    both = a.unionByName(b)
    order = Window.partitionBy("_k", "_b").orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    within = both.withColumn("_own", F.last("_v", ignorenulls=True).over(order)).where("_side = 1").drop("_v", "_side")
    ends = both.where("_k IS NOT NULL AND _b IS NOT NULL").groupBy("_k", "_b").agg(F.max(F.when(F.col("_side") == 0, F.struct("_t", "_v"))).alias("_end"))
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_k", "_b", F.last("_end", ignorenulls=True).over(before).alias("_end")).where("_end IS NOT NULL")
    met = within.join(carried, ["_k", "_b"], "left").withColumn("_got", F.coalesce("_own", "_end._v"))
    return met.select("_row.*", *[F.col(f"_got.{c}").alias(c) for c in columns])
