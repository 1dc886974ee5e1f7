"""Reading the corpus tables of a data directory; only Spark's readers touch the path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def corpus(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")
