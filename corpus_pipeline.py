"""A corpus pipeline over documents: quality, near-duplicates, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factloom.llm import byte_bpe, decontam, oddsketch, quality_ordinal, secret_scan
from factloom.llm.common import read, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels of documents that are here."""
    model = quality_ordinal.train(docs, quality_ordinal.grades_of_labels(read(spark, sf_dir, "labels")), 3)
    return quality_ordinal.select_documents(docs, model, cut=2)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id."""
    return oddsketch.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item in them go."""
    return decontam.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; each secret in a text is replaced by its kind."""
    return secret_scan.redact_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids and their digests."""
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("tokens", tokens)]

#: The first stage is a fitted model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
