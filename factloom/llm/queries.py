"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import shared_folder
from . import bpe_tree, decontaminate, divergence, fill_in_middle, licences, line_dedup, minhash, packing, pii, pitman_yor, quality, secrets, token_counts

VOCABULARY = bpe_tree.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality.quality_figures(docs, quality.calibrated(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(_documents(spark, sf_dir))


def op3_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir), minhash.NearDup(percent=85))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(_documents(spark, sf_dir))


def op5_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.bpe_digests(_documents(spark, sf_dir), VOCABULARY)


def op6_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_digests(_documents(spark, sf_dir))


def op7_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_documents(spark, sf_dir))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths, so folders are invented: each 64 documents of a source and language are one.

    The first of a folder is called LICENSE, and licence files are told by name
    alone, so ``inherited``, ``licence`` and ``from_dir`` say what such a tree
    would pass on; ``own`` and ``cosine`` are the documents' own.
    """
    folder = (F.col("doc_id") / 64).cast("long").cast("string")
    name = F.when(F.col("doc_id") % 64 == 0, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    docs = _documents(spark, sf_dir).select("doc_id", "text", F.concat_ws("/", "source", "lang", folder, name).alias("path"))
    return licences.licences(docs, licences.Templates(file_share=None))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, empty at first: a query's cost then doesn't depend on the ones before."""
    cache = f"{shared_folder(spark)}/token_counts_{uuid4().hex}"
    return token_counts.token_counts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), cache)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's difference from the others of its language, and the terms that tell it from the language."""
    return divergence.source_divergence(_documents(spark, sf_dir))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its transformation's form and lengths, and digests of the output and of the text restored from it."""
    return fill_in_middle.digests(_documents(spark, sf_dir))


def op13_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 2,048 tokens."""
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_quality_bands, op2_pitman_yor, op3_circulant_minhash, op4_secret_scan, op5_bpe_tree, op6_line_windows, op7_latent_leaks, op8_personal_data, op9_licence_scan, op10_token_counts, op11_source_divergence, op12_fill_in_middle, op13_complement_packing)}

ORACLE_SQL: dict[str, str] = {"op6_line_windows": line_dedup.ORACLE_SQL, "op11_source_divergence": divergence.ORACLE_SQL, "op12_fill_in_middle": fill_in_middle.ORACLE_SQL}
