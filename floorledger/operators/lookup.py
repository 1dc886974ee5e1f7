"""Row-level lookups that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than one in this many rows, so there are fewer hot keys than this.
HOT_SHARE = 1000


def hot_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that hold more than ``1 / HOT_SHARE`` of the rows: by construction fewer than HOT_SHARE."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("key_rows"))
    whole = counts.agg(F.sum("key_rows").alias("all_rows"))
    hot = counts.crossJoin(F.broadcast(whole)).where(F.col("key_rows") * HOT_SHARE > F.col("all_rows"))
    return reduce(lambda df, key: df.where(F.col(key).isNotNull()), keys, hot).select(*keys)


def estimated_bytes(frame: DataFrame) -> int:
    """The planner's estimate of a frame's size; nothing runs for it."""
    return int(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def is_broadcast(lookup: DataFrame) -> bool:
    """Whether the planner broadcasts the lookup: its estimated size is within the session's bound."""
    bound = lookup.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return estimated_bytes(lookup) <= bound


def left_join(rows: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """Left join to at most one row per key: a broadcast where the lookup is small, else spread by ``lookup_join``."""
    return rows.join(lookup, keys, "left") if is_broadcast(lookup) else lookup_join(rows, lookup, keys)


def semi_join(rows: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is in the lookup, once each: a broadcast where the lookup is small, else spread likewise."""
    if is_broadcast(lookup):
        return rows.join(lookup, keys, "left_semi").select(*rows.columns)
    known = lookup.select(*keys).distinct().withColumn("_known", F.lit(True))
    return lookup_join(rows, known, keys).where("_known").drop("_known")


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of raw rows to a lookup with at most one row per key.

    Rows are tagged once by a broadcast of the hot keys, whose number is bounded (see ``hot_keys``).  Rows of hot keys,
    and rows whose key is null, are spread over salts; the lookup rows of hot keys are repeated for each salt.  So
    ``rows`` is read twice, once to count, and ``lookup`` once.
    """
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    added = [name for name in lookup.columns if name not in keys]
    keyed = reduce(lambda a, b: a & b, [F.col(key).isNotNull() for key in keys])
    hot = hot_keys(rows, keys).withColumn("is_hot", F.lit(True))
    spread = F.when(F.col("is_hot") | ~keyed, F.monotonically_increasing_id() % salts).otherwise(0)
    tagged = rows.join(F.broadcast(hot), keys, "left").withColumn("salt", spread)
    every = F.sequence(F.lit(0).cast("long"), F.when(F.col("is_hot"), salts - 1).otherwise(0).cast("long"))
    salted = lookup.join(F.broadcast(hot), keys, "left").withColumn("salt", F.explode(every))
    joined = tagged.drop("is_hot").join(salted.drop("is_hot"), [*keys, "salt"], "left")
    return joined.select(*rows.columns, *added)
