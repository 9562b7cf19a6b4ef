"""A language detector: naive Bayes over the most frequent character trigrams of each language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import language_hint, stripped
from ..storage import keep

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_trigrams(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """The columns of texts with each ``gram``: all runs of three characters of a text whose ASCII letters are small and whose other
    ASCII runs are one space, one more at each end.  Each step is a column of its own, so a text is cut into characters once.
    """
    plain = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), r"[\x00-\x60\x7B-\x7F]+", " ")
    chars = docs.select(*columns, F.split(F.concat(F.lit(" "), plain, F.lit(" ")), "").alias("_c"))
    chars = chars.withColumns({"_d": F.slice("_c", F.lit(2), F.size("_c")), "_e": F.slice("_c", F.lit(3), F.size("_c"))})
    joined = lambda a, b: F.concat(a, b)  # noqa: E731  - null where one side has ended
    grams = chars.withColumn("_g", F.zip_with(F.zip_with("_c", "_d", joined), "_e", joined)).drop("_c", "_d", "_e")
    return grams.select("*", F.explode_outer("_g").alias("gram")).drop("_g")


def fit(labelled: DataFrame, languages: list[str], top: int = 500) -> DataFrame:
    """(gram, weights): for each trigram among the ``top`` of a language, its log probability in each of ``languages``.

    Counts are over all rows of (text, lang).  The table has at most ``top`` rows a language, whatever the input; ties go
    by the trigram.  Counts are raised by a half, so no probability is zero.
    """
    seen = with_trigrams(labelled.where(F.col("lang").isin(languages)), "lang").where("gram IS NOT NULL")
    counts = keep(seen.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n")), "trigrams")
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    chosen = counts.withColumn("r", F.row_number().over(first)).where(F.col("r") <= top).select("gram").distinct()
    own = keep(counts.join(F.broadcast(chosen), "gram").groupBy("gram").pivot("lang", languages).agg(F.first("n")).na.fill(0), "profile")
    sums = own.agg(F.count(F.lit(1)).alias("_v"), *[F.sum(F.col(f"`{x}`")).alias(f"_n{i}") for i, x in enumerate(languages)])
    weight = [F.log((F.col(f"`{x}`") + 0.5) / (F.col(f"_n{i}") + 0.5 * F.col("_v"))) for i, x in enumerate(languages)]
    return own.crossJoin(F.broadcast(sums)).select("gram", F.array(*weight).alias("weights"))


def detect(docs: DataFrame, profile: DataFrame, languages: list[str], known: list[str]) -> DataFrame:
    """(doc_id, language, detected, languages): the likeliest language, (lang, prob) of all by falling probability, and the recognizer codes.

    Each text's trigrams meet the profile, broadcast as it is bounded, and are summed up by document before any shuffle.
    Texts without a trigram of the profile have all languages equally likely.
    """
    own = with_trigrams(docs, "doc_id", (F.length(stripped(F.coalesce("text", F.lit("")))) < 8).alias("short"))
    met = own.join(F.broadcast(profile), "gram", "left")
    score = met.groupBy("doc_id", "short").agg(*[F.coalesce(F.sum(F.get("weights", F.lit(i))), F.lit(0.0)).alias(f"_s{i}") for i in range(len(languages))])
    n = range(len(languages))
    prob = lambda i: 1 / sum((F.exp(F.least(F.col(f"_s{j}") - F.col(f"_s{i}"), F.lit(700.0))) for j in n), F.lit(0.0))
    found = F.array(*[F.struct(F.round(prob(i), 6).alias("prob"), F.lit(x).alias("lang")) for i, x in enumerate(languages)])
    score = score.select("doc_id", "short", F.array_sort(found, lambda a, b: F.when(a["prob"] > b["prob"], -1).when(a["prob"] < b["prob"], 1).when(a["lang"] < b["lang"], -1).otherwise(1)).alias("detected"))
    long_enough = F.when(F.col("short"), F.lit("")).otherwise(F.lit("long enough"))
    return score.select("doc_id", F.col("detected")[0]["lang"].alias("language"), "detected", language_hint(long_enough, F.col("detected"), known).alias("languages"))
