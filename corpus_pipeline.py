"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe_tree, decontaminate, line_dedup, minhash, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep, by limits fitted to the labelled ones among them."""
    return quality.quality_filter(docs, quality.calibrated(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines of later three-line repeats; n_chars follows the text.

    A document that loses lines and has no word left goes.
    """
    lines, removed = (next(n for k in range(len(docs.columns) + 1) if (n := f"{name}_{k}") not in docs.columns) for name in ("n_lines", "n_removed"))
    out = line_dedup.dedup_lines(docs, counts=(lines, removed))
    out = out.where((F.col(removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, Jaccard 0.8 or more): that of the least id."""
    return minhash.without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a leaked benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the token ids and of their decoding."""
    return bpe_tree.bpe_digests(docs, bpe_tree.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_windows),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", token_ids),
]

#: Compression ratios and trained models have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
