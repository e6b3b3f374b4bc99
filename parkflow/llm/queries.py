"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parkflow.llm import langid, licenses, manifest, media, mixing, neardup, oracles, packing, pii, quality, substrings, tokencount, topk, trie
from parkflow.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan_pii(table(spark, sf_dir, "documents"))
    percent = F.transform("scores", lambda x: F.round(100 * x).cast("int").cast("string"))
    return found.withColumn("scores", F.array_join(percent, ","))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.store_media(table(spark, sf_dir, "documents")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), 4096)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"))
    position = lambda r: F.round(F.get("positions", F.lit(r)), 9)
    return mix.withColumns({"first_position": position(0), "second_position": position(1), "third_position": position(2)}).drop("positions")


def op9_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op10_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2048)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents")).drop("n_repeats", "longest_repeat", "repeats")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verify_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_pii_spans": op3_pii_spans,
    "op4_media_columns": op4_media_columns,
    "op5_token_counts": op5_token_counts,
    "op6_language_id": op6_language_id,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_mix_sources": op8_mix_sources,
    "op9_repeated_strings": op9_repeated_strings,
    "op10_pack_sequences": op10_pack_sequences,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_quality_rules": op12_quality_rules,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL
