"""The queries of this subpackage: name -> function of (spark, sf_dir), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm import chat, decontaminate, exact_dedup, language, mixing, near_dedup, prefix_trie, quality, sharding, tiff, token_store, toxicity, whitening
from lumenfold.llm.common import read_table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), epochs=3)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), percent=85)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents"), leaves=16)


def op6_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_flat(read_table(spark, sf_dir, "conversations"))


def op7_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_media(read_table(spark, sf_dir, "documents"))


def media_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reader of op7: one row per page of the texts stored as TIFF."""
    return tiff.text_pages(read_table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), percent=80)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(read_table(spark, sf_dir, "documents"))


def op10_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.tokenize_and_index(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read_table(spark, sf_dir, "conversations"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_toxicity": op2_toxicity,
    "op3_near_dedup": op3_near_dedup,
    "op4_quality": op4_quality,
    "op5_kd_shards": op5_kd_shards,
    "op6_chat_perspectives": op6_chat_perspectives,
    "op7_tiff_media": op7_tiff_media,
    "media_pages": media_pages,
    "op8_decontaminate": op8_decontaminate,
    "op9_language_id": op9_language_id,
    "op10_token_orc": op10_token_orc,
    "op11_whitening": op11_whitening,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": mixing.ORACLE_SQL,
    "op6_chat_perspectives": chat.ORACLE_SQL,
    "op8_decontaminate": decontaminate.ORACLE_SQL,
    "op12_prefix_trie": prefix_trie.ORACLE_SQL,
    "op13_exact_dedup": exact_dedup.ORACLE_SQL,
}
