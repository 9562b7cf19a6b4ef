"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import keep


def numbered(rows: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with their number from 0 within the group, by ``order``; ties in any order.

    Rows are dealt by ranges of (group, order), so a large group lies in several ranges.  They are numbered within each
    range, and a small table of counts by range and group, summed over the ranges before, gives the rest.
    """
    part = F.spark_partition_id().alias("_part")
    by = [*groups, *order]
    dealt = rows.repartitionByRange(*by).select("*", part)
    local = keep(dealt.withColumn(name, F.row_number().over(Window.partitionBy("_part", *groups).orderBy(*order)).cast("long") - 1), "numbered")
    counts = local.groupBy("_part", *groups).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("_before", before).drop("_n")
    met = local.alias("l").join(offsets.alias("o"), [F.col(f"l.{c}").eqNullSafe(F.col(f"o.{c}")) for c in ("_part", *groups)])
    return met.select(*[F.col(f"l.{c}") for c in rows.columns], (F.col(f"l.{name}") + F.col("o._before")).alias(name))
