"""Exact sums and guarded percentages.

Amounts are stored as DOUBLE.  Summing doubles gives a result that depends on the order in which
partitions arrive, so a report could change between two runs.  ``total`` instead adds the whole part
and the millionths as two longs: exact to six decimals, order independent, no overflow at any
realistic volume, and both buffers are fixed width, so the sum stays in a code-generated hash
aggregate (a decimal sum costs about five times as much per row).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from floorledger.functions.rounding import round_half_even, round_half_up

MILLIONTH = Decimal("0.000001")


def whole_part(value: Column) -> Column:
    return F.floor(value)


def millionths(value: Column) -> Column:
    return F.rint((value - F.floor(value)) * 1_000_000).cast("long")


def joined(whole_sum: Column, millionth_sum: Column) -> Column:
    """The two long sums as one decimal with six places."""
    return whole_sum.cast("decimal(25,6)") + millionth_sum.cast("decimal(19,0)") * F.lit(MILLIONTH)


def total(column: str | Column) -> Column:
    """Exact sum of a DOUBLE column as a decimal with six places; null over no rows."""
    value = F.col(column) if isinstance(column, str) else column
    return joined(F.sum(whole_part(value)), F.sum(millionths(value)))


def or_zero(column: str | Column) -> Column:
    """A count or an exact sum, 0 where a join found nothing."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(0))


def amount(column: str | Column) -> Column:
    """Exact sum back to the DOUBLE type that reports show."""
    return (F.col(column) if isinstance(column, str) else column).cast("double")


def ratio_pct(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` as double, 0 where the whole is missing or 0."""
    return F.when(whole != 0, F.coalesce(part, F.lit(0.0)) / whole * 100.0).otherwise(F.lit(0.0))


def share_pct(part: Column, whole: Column, rows: Column) -> Column:
    """``part`` of ``whole`` in percent, 0 over no rows or a whole of 0.

    The row count is not needed for the value.  Asking for it makes the plan of the whole need the same
    partial aggregates as the plan of the parts, so Spark reuses that shuffle and scans the ledger once.
    """
    return F.when(rows > 0, ratio_pct(part, whole)).otherwise(F.lit(0.0))


def pct_half_up(part: Column, whole: Column, places: int) -> Column:
    """Rounded percentage, ties away from zero; 0 unless the whole is positive."""
    return F.when(whole > 0, round_half_up(part * 100.0 / whole, places)).otherwise(F.lit(0.0))


def pct_half_even(part: Column, whole: Column, places: int) -> Column:
    """Rounded percentage, ties to the even digit; 0 unless the whole is positive."""
    return F.when(whole > 0, round_half_even(part * 100.0 / whole, places)).otherwise(F.lit(0.0))

