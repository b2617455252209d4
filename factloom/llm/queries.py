"""The registered queries of the text operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontam, divergence, fst_count, html_lstm, langid, oddsketch, oracles, prefix_tree, quality_ordinal, secret_scan, suffix_dedup, turn_repair, vector_codes
from .common import read


def op1_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality_ordinal.train(docs, quality_ordinal.grades_of_labels(read(spark, sf_dir, "labels")), 3)
    return quality_ordinal.score_documents(docs, model, cut=2)


def op4_ngram_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op5_html_lstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_lstm.extract(read(spark, sf_dir, "pages"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))


def op7_oddsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oddsketch.near_duplicates(read(spark, sf_dir, "documents"))


def op2_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return divergence.apply_rules(docs, divergence.learn(docs))


def op3_pigeonhole_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op9_fst_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fst_count.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(read(spark, sf_dir, "documents"))


def op11_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tree.joined(read(spark, sf_dir, "documents"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damage(read(spark, sf_dir, "conversations")))


def op13_filtering_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_vectors(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_ordinal, op2_divergence_rules, op3_pigeonhole_decontam, op4_ngram_langid, op5_html_lstm, op6_suffix_dedup, op7_oddsketch_dedup, op8_byte_bpe, op9_fst_token_counts, op10_trigram_secrets, op11_prefix_tree_join, op12_turn_repair, op13_filtering_lloyd)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
