"""Corpus pipeline: quality, near-duplicates, benchmark leaks, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept. The first four return the columns of ``documents``; the last returns the
ids of each text and what they decode to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflight.llm import decontam, pii, simhash, spm, zstd_quality
from shelflight.llm.common import shared_dir, surrogate_key


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return zstd_quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least doc_id."""
    return simhash.keep_first(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontam.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in place of personal data; n_chars follows the new text."""
    replaced = pii.replace_entities(docs, surrogate_key(spark), count=None)
    length = F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return replaced.withColumn("n_chars", length)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of each text, and their decoding."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = spm.encode(docs.select("doc_id", "text"), model, decoded="decoded", drop_text=True)
    return coded.select("doc_id", "ids", "decoded", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_leaks),
    ("pii_surrogates", personal_data),
    ("sentencepiece", token_ids),
]

#: SQL has neither the models nor the libraries of these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
