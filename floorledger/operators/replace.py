"""Range replace: a batch supersedes the days it spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def batch_bounds(batch: DataFrame, day: str) -> DataFrame:
    """One row: first and last day of a batch, null when no row has a day."""
    return batch.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def replace_range(stored: DataFrame, batch: DataFrame, day: str) -> DataFrame:
    """Stored rows outside the day range of the batch, plus the batch.

    Undated stored rows stay, and a batch without any day only adds.
    """
    bounded = stored.crossJoin(F.broadcast(batch_bounds(batch, day)))
    outside = (
        F.col(day).isNull() | F.col("first_day").isNull() | ~F.col(day).between(F.col("first_day"), F.col("last_day"))
    )
    return bounded.where(outside).select(*stored.columns).unionByName(batch)
