"""Corpus preparation: quality, language, near-duplicates, secrets and packing, stage after stage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.llm import arrow, langid, nearcopies, packing, quality, secrets, storage


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold go; null and empty texts are scored like any."""
    model = quality.learn(docs, arrow.read(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model, threshold=0.3)


def language_identification(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones too), in which no language holds 0.35 of the words, or without evidence for any learned language, go."""
    return langid.keep_identified(docs, langid.learn(docs), least=0.35)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles alike to 0.8 or more) stays, the one with the smallest id; texts without words are alike."""
    return nearcopies.keep_one_each(docs, least=0.8)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and n_chars follows the text; a null text stays null, with a null n_chars."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: one row a piece; a null or empty text is its end token alone."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("language_identification", language_identification),
    ("simhash_near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Learned models, fingerprints and token ids aren't expressible in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's rows are settled as a table in the shared folder."""
    docs = arrow.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = storage.new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
