"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivet.llm import bpe_words, exact_dedup, kmeans_tree, language, licenses, lm_trie, mixing, ngram_join, pii, repair, runs, secrets, token_count
from trivet.llm.common import table


def tokenizer(name: str) -> str:
    """A public tokenizer's file; installed with the Python environment, never part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents")).drop("set_print")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op6_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_words.encode_decode(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.withColumn("weight", F.round("weight", 6))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_trie.lm_scores(table(spark, sf_dir, "documents"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.nearest(table(spark, sf_dir, "embeddings"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_report(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(table(spark, sf_dir, "conversations"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.runs_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_token_count": op4_token_count,
    "op5_language_id": op5_language_id,
    "op6_bpe_roundtrip": op6_bpe_roundtrip,
    "op7_pii": op7_pii,
    "op8_source_mix": op8_source_mix,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_nearest": op10_nearest,
    "op11_secret_scan": op11_secret_scan,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES: dict[str, str] = {
    "op1_ngram_join": ngram_join.ORACLE,
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op3_license_scan": licenses.ORACLE,
    "op8_source_mix": mixing.ORACLE,
    "op12_conversation_repair": repair.ORACLE,
}
