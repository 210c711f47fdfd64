"""The training-data pipeline: five stages over ``documents``.

Each stage takes the documents its predecessor kept. ``run`` writes every stage's
result as Parquet in the shared checkpoint folder and reads it again, so a lost
executor costs one stage at most.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import stages
from tickloom.session import durable, ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", stages.quality_classifier),
    ("simhash_near_dedup", stages.near_copies),
    ("benchmark_decontamination", stages.benchmark_decontamination),
    ("pii", stages.redaction),
    ("bpe", stages.tokens),
]
#: Language models, fingerprints and tokenizers are not SQL: tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
