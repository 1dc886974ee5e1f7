"""Intermediate tables in the folder that all executors share, and Arrow batches of a bounded number of rows."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from floorledger.session import scratch_folder
from floorledger.sinks.files import Files

# Rows of whole texts in one Arrow batch: what a Python worker holds at a time.
TEXTS_PER_BATCH = 256

# Folders of the tables stored in each ``temporary`` block that is open.
_open: list[list[str]] = []

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches(spark: SparkSession, rows: int = TEXTS_PER_BATCH) -> Iterator[None]:
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside are removed at the end, unless they were stored to be kept."""
    _open.append([])
    try:
        yield
    finally:
        files = Files(spark)
        for folder in _open.pop():
            files.delete(folder)


def stored(frame: DataFrame, rows_per_batch: int = TEXTS_PER_BATCH, keep: bool = False) -> DataFrame:
    """The frame written once as Parquet in the shared folder and read again: its lineage ends there."""
    spark = frame.sparkSession
    folder = scratch_folder(spark)
    if _open and not keep:
        _open[-1].append(folder)
    path = f"{folder}/table"
    with batches(spark, rows_per_batch):
        frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
