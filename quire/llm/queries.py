"""The queries of this package's operators over the tables of a data folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, jaccard, lattice, lines, packing, pieces, pii, quality, reputation, sampling, substrings, toxicity, whitening


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op2_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lattice.score(documents(spark, sf_dir)).withColumnRenamed("score", "piece_score")
    return scores.withColumnRenamed("learned_score", "score").select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "piece_score", "mixed_score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(documents(spark, sf_dir))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op6_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.report(documents(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal(documents(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir)).drop("ids")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_boilerplate(documents(spark, sf_dir).select("doc_id", "text", "source"), n_lines="n_lines", n_dropped="n_dropped")
    return kept.select("doc_id", "n_lines", "n_dropped", "text")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(conversations.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reputation.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_jaccard_join, op2_subword_lattice, op3_toxicity, op4_quality_rules, op5_personal_data, op6_weighted_sampling, op7_substring_dedup, op8_best_fit_packing, op9_sentencepiece, op10_line_dedup, op11_conversation_repair, op12_embedding_whitening, op13_url_filters)}

ORACLES: dict[str, str] = {"op1_jaccard_join": jaccard.ORACLE, "op7_substring_dedup": substrings.ORACLE, "op10_line_dedup": lines.ORACLE, "op13_url_filters": reputation.ORACLE}
