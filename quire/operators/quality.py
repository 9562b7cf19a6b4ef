"""Confidence summaries, page and file roll-ups, and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENGINES = ("primary", "secondary")


def region_confidence(words: DataFrame, regions: DataFrame, confidence: str = "confidence", threshold: float = 60.0) -> DataFrame:
    """(doc_id, region_id, mean, lowest, n_words, low_fraction); a region without words has 0, 0, 0 and 1."""
    low = F.when(F.col(confidence) < threshold, 1.0).otherwise(0.0)
    g = words.groupBy("doc_id", "region_id").agg(F.avg(confidence).alias("mean"), F.min(confidence).alias("lowest"), F.count(F.lit(1)).alias("n_words"), F.avg(low).alias("low_fraction"))
    filled = {"mean": 0.0, "lowest": 0.0, "n_words": 0, "low_fraction": 1.0}
    return regions.select("doc_id", "region_id").join(g, ["doc_id", "region_id"], "left").na.fill(filled)


def reconciled_regions(words: DataFrame, threshold: float, with_text: bool = False) -> DataFrame:
    """(doc_id, region_id, n, mean1, mean2, winner, mean, lowest, low_fraction[, text]) of words with both confidences.

    The engine of greater mean wins, the first on ties; mean, lowest and low_fraction are the winner's.
    One aggregate holds both engines, so nothing joins back.
    """
    stats = lambda c: [F.avg(c), F.min(c), F.avg(F.when(F.col(c) < threshold, 1.0).when(F.col(c).isNotNull(), 0.0))]
    names = ("mean", "lowest", "low_fraction")
    ws = [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "word_id", "text"))), lambda w: w["text"]), " ").alias("text")] * with_text
    g = words.groupBy("doc_id", "region_id").agg(F.count(F.lit(1)).alias("n"), *[x.alias(f"{name}{e}") for e, c in ((1, "confidence"), (2, "confidence2")) for name, x in zip(names, stats(c), strict=True)], *ws)
    second = F.coalesce(F.col("mean2") > F.coalesce("mean1", F.lit(0.0)), F.lit(False))
    won = [F.when(second, F.col(f"{name}2")).otherwise(F.col(f"{name}1")).alias(name) for name in names]
    return g.select("doc_id", "region_id", "n", "mean1", "mean2", F.when(second, ENGINES[1]).otherwise(ENGINES[0]).alias("winner"), *won, *["text"] * with_text)


def region_stats(own: Column, threshold: float) -> Column:
    """The record of ``reconciled_regions`` of one region from the array of its words; no mean, lowest and low_fraction without words."""

    def stats(c: str) -> Column:
        some = F.filter(F.transform(own, lambda w: w[c]), lambda x: x.isNotNull())
        share = lambda total, xs: F.when(F.size(xs) > 0, total / F.size(xs))
        return F.transform(F.array(some), lambda xs: F.struct(share(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x), xs).alias("mean"), F.array_min(xs).alias("lowest"), share(F.size(F.filter(xs, lambda x: x < threshold)), xs).alias("low_fraction")))

    def record(both: Column) -> Column:
        one, two = both[0], both[1]
        second = F.coalesce(two["mean"] > F.coalesce(one["mean"], F.lit(0.0)), F.lit(False))
        won = F.when(second, two).otherwise(one)
        return F.struct(F.size(own).cast("long").alias("n"), F.when(second, ENGINES[1]).otherwise(ENGINES[0]).alias("winner"), *[won[c].alias(c) for c in ("mean", "lowest", "low_fraction")])

    return F.get(F.transform(F.array(F.concat(stats("confidence"), stats("confidence2"))), record), F.lit(0))


def is_low(low_fraction: Column, n_words: Column, fraction: float = 0.15) -> Column:
    """No words, or a share of words under the threshold of ``fraction`` or more."""
    return (n_words == 0) | (low_fraction >= fraction)


def engine_wins(prefix: str = "wins_") -> tuple[Column, Column]:
    """(engines that won, their counts as name:count) from one summed column for each engine."""
    won = [(F.sum(prefix + e), e) for e in ENGINES]
    listed = lambda form: F.concat_ws(",", *[F.when(n > 0, form(n, e)) for n, e in won])
    return listed(lambda n, e: F.lit(e)), listed(lambda n, e: F.concat(F.lit(f"{e}:"), n.cast("string")))


def sorted_set(column: str | Column) -> Column:
    return F.array_join(F.sort_array(F.collect_set(column)), ",")


def duration(seconds: Column) -> Column:
    """Minutes and seconds as ``3m 7s``; seconds round half up."""
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), F.floor(seconds % 60 + 0.5).cast("string"), F.lit("s"))
