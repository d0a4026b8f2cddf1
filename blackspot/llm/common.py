"""Shared steps of the text operators."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from blackspot.runtime import cut

#: Stands for a missing doc_id inside the operators: it sorts before all others.
MISSING = -(1 << 63)
#: Rows with text in an Arrow batch.
ROWS = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(MISSING))


def id_back(column: Column) -> Column:
    return F.when(column != MISSING, column)


@contextlib.contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ``ROWS`` rows for the jobs started inside.

    Rows hold whole texts here; the usual 10,000 of them at once would decide the
    memory of a task.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table on shared files, written with Arrow batches of ``ROWS`` rows."""
    with text_batches(df.sparkSession):
        return cut(df)


def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, at most ``ROWS`` at a time, for tasks whose batches the caller's session sizes."""
    for b in batches:
        for row in range(0, len(b), ROWS):
            yield b.slice(row, ROWS)
        pa.default_memory_pool().release_unused()
