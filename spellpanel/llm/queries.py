"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spellpanel.llm import (alignment, decontaminate, extraction, langid, mixing, neardup, quality, sentences, sharding, spelling,
                            substrings, tokens, vectors)
from spellpanel.llm import sql as twins

#: Rank file of a public byte-level tokenizer for many languages, and its split pattern.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The two public tokenizers that are aligned: a byte-level one and one of word pieces.
FIRST, SECOND = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_dedup(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_main_text(table(spark, sf_dir, "pages"))


def op5_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.repeated_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op7_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_answers(table(spark, sf_dir, "documents"), VOCABULARY, tokens.PATTERN)


def op8_min_max_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85, rows=6)


def op9_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op11_merge_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_digest(table(spark, sf_dir, "documents"), FIRST, SECOND)


def op12_trie_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), typo=199)


def op13_sign_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


QUERIES: dict[str, Query] = {
    "op1_sentence_spans": op1_sentence_spans,
    "op2_mix_sources": op2_mix_sources,
    "op3_quality_rules": op3_quality_rules,
    "op4_template_text": op4_template_text,
    "op5_latent_leaks": op5_latent_leaks,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_token_lengths": op7_token_lengths,
    "op8_min_max_neardup": op8_min_max_neardup,
    "op9_language_codes": op9_language_codes,
    "op10_shard_documents": op10_shard_documents,
    "op11_merge_path": op11_merge_path,
    "op12_trie_pairs": op12_trie_pairs,
    "op13_sign_hashes": op13_sign_hashes,
}

ORACLES: dict[str, str] = {
    "op2_mix_sources": twins.MIX_SOURCES,
    "op3_quality_rules": twins.QUALITY_RULES,
    "op10_shard_documents": twins.SHARD_DOCUMENTS,
    "op12_trie_pairs": twins.SPELLING_VARIANTS,
    "op13_sign_hashes": twins.NEAR_VECTORS,
}
