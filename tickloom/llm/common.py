"""Helpers of this subpackage: tables, registry, batches of bounded size."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import durable, ship_package

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and its check SQL where there is one."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def prepare(spark: SparkSession) -> None:
    """The package on all workers, and batches of rows that fit texts.

    Spark hands Python 10,000 rows at once unless told otherwise; with whole documents
    that is memory without use. A setting of the user's own is left alone.
    """
    ship_package(spark)
    if spark.conf.get(BATCH_ROWS, None) in (None, "10000"):
        spark.conf.set(BATCH_ROWS, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(rows: DataFrame, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    spark = rows.sparkSession
    durable(spark.range(1))  # sets the checkpoint folder where it is unset
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice hold about ``limit`` bytes, one row at least.

    Only how much is worked on at once changes, never what.
    """
    for batch in batches:
        column = batch.column(text)
        start, held = 0, 0
        sizes = pc.binary_length(column).fill_null(0).to_pylist()
        for i, size in enumerate(sizes):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)
        pa.default_memory_pool().release_unused()


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """Texts of a batch, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``docs`` is called so."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_share(hashed: Column, share: float | Column) -> Column:
    """True for about ``share`` of all hash values: a sample that is small before it moves,
    however many tasks there are, unlike the first rows of every task."""
    steps = 1 << 30
    return F.pmod(hashed, F.lit(steps)) < (F.lit(share) if isinstance(share, float) else share) * steps
