"""Mergeable sketches kept as columns: distinct counts and quantiles by group, rolled up without the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sketched(rows: DataFrame, groups: list[str], distinct: Column, measure: Column, lg_k: int = 14, k: int = 400) -> DataFrame:
    """(groups, n, distinct_sketch, quantile_sketch): HyperLogLog of ``distinct`` and KLL of the whole numbers ``measure``.

    At lg_k = 14 the relative deviation of a distinct count is about 0.8 %; at k = 400 the rank of a quantile is off by
    under 1 %.  Sketches of parts merge, so a group of any size is combined before the shuffle.
    """
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(distinct, lg_k).alias("distinct_sketch"), F.kll_sketch_agg_bigint(measure, k).alias("quantile_sketch"))


def rolled_up(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """The same of coarser groups, from the sketches alone."""
    return sketches.groupBy(*groups).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_bigint("quantile_sketch").alias("quantile_sketch"))


def n_distinct(sketch: str = "distinct_sketch") -> Column:
    return F.hll_sketch_estimate(sketch)


def quantile(at: float, sketch: str = "quantile_sketch") -> Column:
    return F.kll_sketch_get_quantile_bigint(sketch, F.lit(at))


def rank(of: Column, sketch: str = "quantile_sketch") -> Column:
    """The share of values at or below ``of``."""
    return F.kll_sketch_get_rank_bigint(sketch, of)
