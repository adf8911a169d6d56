"""A corpus from raw documents to tokens: five stages, each over all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe_tree, exact_dedup, mixing, quality, simhash
from quillon.llm.common import new_path, read_table, remove, scratch, small_batches

VOCABULARY = "byte_bpe_50k.tiktoken"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    small_batches(spark)
    return quality.filter_documents(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more), the smallest doc_id stays."""
    small_batches(spark)
    return simhash.drop_near_duplicates(docs, shingle=5, least=0.8)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row for each use of a document, with the words that are used."""
    small_batches(spark)
    return mixing.mix_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each row, and the SHA-256 of the bytes that they decode to, beside its doc_id, lang and source."""
    small_batches(spark)
    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    return bpe_tree.encode_documents(docs, path, pattern, decoded_col="decoded_sha256", keep=["doc_id", "lang", "source", "n_chars"])


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("source_mix", mix_stage),
    ("byte_bpe", bpe_stage),
]

#: Shingle sets, permuted blocks and BPE have no SQL; tests/llm/test_pipeline.py recomputes every stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet in the shared folder and read again.

    What a stage has written on its way goes when its result is there, and its input with it; the last result goes when
    the application ends.
    """
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
