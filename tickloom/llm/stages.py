"""Stages of the pipeline: each applies one operator to the documents it is given.

A stage takes ``(spark, docs, sf_dir)``. All but the last return the columns of ``docs``.
Rows are found again by a hash of their id and content, so documents with a null or
repeated id are judged by row.
"""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, decontaminate, neardup, pii, quality, simhash
from tickloom.llm.common import free_name, prepare, table

TOKENIZER = "byte_bpe_50k.json"


def _key() -> Column:
    return F.xxhash64("doc_id", "text", "lang")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    prepare(spark)
    name = free_name(docs, "_key")
    judged = quality.classify(docs, table(spark, sf_dir, "labels"), key=_key())
    rejected = judged.filter(~F.col("keep")).select(F.col("key").alias(name)).distinct()
    return docs.withColumn(name, _key()).join(rejected, name, "left_anti").drop(name)


def _one_of_each(docs: DataFrame, representatives: Callable[[DataFrame, Column], DataFrame]) -> DataFrame:
    name = free_name(docs, "_key")
    kept = representatives(docs, _key()).withColumnRenamed("key", name)
    # rows repeated whole have one key: one of them stays
    return docs.withColumn(name, _key()).join(kept, name, "left_semi").dropDuplicates([name]).drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of op6's query: that with the least id."""
    prepare(spark)
    return _one_of_each(docs, simhash.representatives)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with a five-word similarity of 0.8 or more:
    that with the least id."""
    prepare(spark)
    return _one_of_each(docs, neardup.representatives)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark passage."""
    prepare(spark)
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts replaced by its kind; ``n_chars`` follows the text."""
    prepare(spark)
    clean = pii.redact(docs, pii.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, token_ids``: the ids of the kept documents, packed. The
    ids are decoded again: ``decoded_sha256`` of that text, and ``intact`` if it is the document's."""
    prepare(spark)
    rows = docs.select("doc_id", "text", "lang", "source")
    return bpe.encode(rows, public_tokenizers.path(TOKENIZER), decoded="decoded").select(
        "doc_id", "lang", "source", "n_tokens", "token_ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("intact"),
    )
