"""Leaving out rows whose key cannot be among the wanted ones, before they are aggregated and shuffled.

The wanted keys are hashed to a fixed number of bits, kept as words of 64: a table whose size has the same bound however
many keys there are, so that it can be broadcast.  A row passes if its key's bit is set.  All wanted keys pass, and the
fewer bits are set, the fewer others do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorledger.operators.lookup import estimated_bytes

# At most FILTER_BITS / 64 words of 16 bytes: 4 MB.
FILTER_BITS = 1 << 24
# Rows are filtered where they are estimated at this many bytes, and at this many times what gives the keys.
LEAST_BYTES, LEAST_RATIO = 1 << 30, 4


def is_worth_filtering(rows: DataFrame, wanted: DataFrame) -> bool:
    size = estimated_bytes(rows)
    return size >= LEAST_BYTES and size >= LEAST_RATIO * estimated_bytes(wanted)


def _bit(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))


def key_words(wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``_word, _bits``: the set bits of the wanted keys, 64 to a row."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_bit") % 64).cast("int"))
    placed = wanted.select(_bit(keys).alias("_bit"))
    return placed.groupBy(F.shiftright("_bit", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))


def possible_rows(rows: DataFrame, keys: list[str], words: DataFrame, other: bool = False) -> DataFrame:
    """Rows whose key may be a wanted one, or with ``other`` all others."""
    placed = rows.withColumn("_bit", _bit(keys)).withColumn("_word", F.shiftright("_bit", 6))
    found = placed.join(F.broadcast(words), "_word", "left" if other else "inner")
    is_set = F.call_function("shiftrightunsigned", F.col("_bits"), (F.col("_bit") % 64).cast("int")).bitwiseAND(1) == 1
    return found.where(~F.coalesce(is_set, F.lit(False)) if other else is_set).select(*rows.columns)


def filtered(rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """The rows, cut down to possible keys where that is worth a second look at what gives the keys."""
    return possible_rows(rows, keys, key_words(wanted, keys)) if is_worth_filtering(rows, wanted) else rows
