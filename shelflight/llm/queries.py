"""Registered queries of the corpus operators: each runs over its whole table.

The operators have general interfaces; a query applies one with production
parameters and derives the columns of its contract.
"""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflight.llm import (
    align,
    decontam,
    merkle,
    paragraph_dedup,
    pii,
    quality_rules,
    secret_scan,
    sharding,
    simhash,
    spm,
    token_frames,
    warc,
    zstd_quality,
)
from shelflight.llm.common import shared_dir, surrogate_key
from shelflight.llm.merkle_sql import MANIFEST_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard among 16 by jump consistent hashing of doc_id."""
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), 16)


def op2_line_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counters of every document and the verdict of line-first cleaning."""
    return quality_rules.clean_lines(_table(spark, sf_dir, "documents"), with_text=False)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found, with the item."""
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that repeat across documents, where they stand, and where they stay."""
    return paragraph_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    groups = simhash.simhash_groups(_table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return groups.select("doc_id", digits.alias("fingerprint"), "component_id")


def op6_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document from dictionaries fitted on rows that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = zstd_quality.fit(docs, _table(spark, sf_dir, "labels"))
    scored = zstd_quality.score(docs.select("doc_id", "text"), model, keep_text=False)
    return scored.select(
        "doc_id",
        zstd_quality.is_held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with keyed surrogates in place of personal data."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_entities(docs, surrogate_key(spark))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document and their decoding, as digests."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = spm.encode(docs, model, decoded="decoded", drop_text=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page, written as WARC files and read back."""
    path = shared_dir(spark, "warc")
    warc.write_derivatives(_table(spark, sf_dir, "pages"), path)
    read = warc.read_records(spark, path)
    block = F.col("block").cast("string")
    return read.select(
        "page_id",
        "kind",
        "record_id",
        "refers_to",
        "url",
        F.col("headers")["WARC-Payload-Digest"].alias("payload_digest"),
        F.col("headers")["WARC-Block-Digest"].alias("block_digest"),
        F.octet_length("block").cast("long").alias("n_bytes"),
        F.when(F.col("kind") == "metadata", F.get_json_object(block, "$.HTML.title")).alias("title"),
        F.when(F.col("kind") == "conversion", block).alias("text"),
    )


def op10_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level ids of every document written as zstandard frames, read back as digests."""
    path = shared_dir(spark, "tokens")
    docs = _table(spark, sf_dir, "documents")
    token_frames.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_frames.read_digests(spark, path)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and root, checked for copies of which a third have lower-cased texts."""
    docs = _table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    claimed = {"text": F.when(tampered, lowered).otherwise(F.col("text"))}
    return merkle.prove(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", claimed).drop("proof")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers cover every document's bytes, with corpus-wide counts of linked ids."""
    byte_level, pieces = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align.align_documents(_table(spark, sf_dir, "documents"), byte_level, pieces)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document: fixed patterns, and literals that reach names of secrets."""
    found = secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))
    own = F.col("findings")
    return found.select(
        "doc_id",
        *[secret_scan.of_kind(own, kind).alias(f"n_{kind}") for kind in secret_scan.BASE_KINDS],
        F.sha2(secret_scan.spelled(own, secret_scan.BASE_KINDS), 256).alias("base_sha256"),
        secret_scan.spelled(own).alias("spans"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jump_sharding": op1_jump_sharding,
    "op2_line_quality_rules": op2_line_quality_rules,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_paragraph_dedup": op4_paragraph_dedup,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_zstd_quality": op6_zstd_quality,
    "op7_pii_surrogates": op7_pii_surrogates,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_warc_derivatives": op9_warc_derivatives,
    "op10_token_frames": op10_token_frames,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_secret_scan": op13_secret_scan,
}

#: The other results rest on hashes, models or libraries that SQL does not have.
ORACLE_SQL: dict[str, str] = {"op11_merkle_manifest": MANIFEST_SQL}
