"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_automaton, brown_lm, decontaminate, language_id, license_scan, ngram_join, oracles, quality_rules, sharding, url_filter, warc_zip
from .common import crc_fold, table


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary lies; ``LOOMTEXT_VOCABULARY`` names another file."""
    if own := os.environ.get("LOOMTEXT_VOCABULARY"):
        return own
    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return public_tokenizers.path(name)
    return f"/opt/tokenizers/{name}"


def op1_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.through_archives(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op2_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.token_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op6_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_fold(F.col("doc_id"), 7) == 2).alias("held_out"))
    return brown_lm.score_corpus(docs, docs.where(~F.col("held_out")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_fold(F.col("doc_id"), 5) == 0
    learned = language_id.learn_dictionaries(docs.where(~held_out))
    return language_id.identify_language(docs.select("doc_id", held_out.alias("held_out"), "text"), learned).select(
        "doc_id", "held_out", "lang_pred", "score", "lang_accepted"
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"),
    )


def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, bias = url_filter.train(url_filter.labelled_urls(spark))
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), weights, bias).select(
        "page_id", "host", "path", "rule", "verdict", "block_score"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc_zip, op2_bpe_automaton, op3_license_scan, op4_ngram_join, op5_quality_rules, op6_brown_lm, op7_language_id, op8_decontaminate, op9_virtual_slots, op10_url_filter)
}
ORACLES: dict[str, str] = {"op1_warc_zip": oracles.OP1, "op4_ngram_join": oracles.OP4, "op5_quality_rules": oracles.OP5, "op8_decontaminate": oracles.OP8}
