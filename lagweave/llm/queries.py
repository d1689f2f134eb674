"""The registered queries of this subpackage, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, compression, fillmiddle, langid, media, negatives, packing, quality, secrets, sharding, simhash, toxicity
from .arrow import read

#: The limit of a shard of documents: one read of a training loader.
SHARD_BYTES = 1 << 20


def op1_secret_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base patterns and runs that a battery of randomness tests can't tell from random ones."""
    return secrets.secret_spans(read(spark, sf_dir, "documents"))


def op2_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation that no other one continues, rendered in parts."""
    return chat.format_conversations(read(spark, sf_dir, "conversations"))


def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts, compression ratios and the verdict of every document."""
    return compression.compression_rules(read(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as an image in archives and read back by byte ranges, with digests and features."""
    return media.store_and_digest(read(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces with their places in sequences of 2048 tokens. No bound on documents or cost beyond what the tokens allow: the three residuals weigh alike."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary, capacity=2048, end_id=0)


def op6_language_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model that never saw the held-out fold."""
    return langid.document_languages(read(spark, sf_dir, "documents"))


def op7_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, none beyond ``SHARD_BYTES``."""
    return sharding.shards(read(spark, sf_dir, "documents"), SHARD_BYTES)


def op8_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, by a model that never saw the held-out fold."""
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of the text decoded from them."""
    return bpe.round_trip_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's 64-bit fingerprint and the smallest id that links of at most 3 differing bits reach."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), radius=3)


def op11_sliced_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 5 hard negatives of every anchor and positive, by exact integer products."""
    return negatives.hard_negatives(read(spark, sf_dir, "embeddings"))


def op12_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, by a model that never saw the held-out fold."""
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged by units of letters and single characters, and what the output restores."""
    return fillmiddle.digests(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_secret_randomness,
        op2_chat_snapshots,
        op3_compression_bands,
        op4_media_columns,
        op5_best_fit_packing,
        op6_language_chain,
        op7_extendible_shards,
        op8_quality_attention,
        op9_bpe_round_trip,
        op10_simhash_near_duplicates,
        op11_sliced_negatives,
        op12_subword_toxicity,
        op13_fill_in_middle,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """What DuckDB can express over whole tables; the rest is tested against brute force."""
    return {"op2_chat_snapshots": chat.ORACLE_SQL, "op7_extendible_shards": sharding.oracle_sql(SHARD_BYTES), "op11_sliced_negatives": negatives.ORACLE_SQL, "op13_fill_in_middle": fillmiddle.ORACLE_SQL}
