"""Rounding of doubles as the reports define it.

Two rules are in use.  Percentages of the voucher and prize reports take ties away from zero and forgive
the rounding error of the division before them: a value within three parts in 10**16 of a tie is a tie.
Attendance and period percentages round the stored binary value, and only an exact tie goes to the even
digit.  ``F.round`` and ``F.bround`` do neither: they round the shortest decimal text of a double.

Both rules need the product with a power of ten and its exact rounding error (Dekker's product), which
takes plain double arithmetic and stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLITTER = 2.0**27 + 1
# From here on a double has no fraction left to round.
NO_FRACTION = 2.0**52
# Fixed value: relative distance below a tie that still counts as the tie.
TIE_SLACK = 3e-16


def _parts(value: Column, places: int) -> tuple[Column, Column, Column, Column]:
    """Scaled size, the whole number below it, its distance from half way, and that distance's error."""
    scale = float(10**places)
    size = F.abs(value)
    product = size * scale
    high = size * SPLITTER - (size * SPLITTER - size)
    error = (high * scale - product) + (size - high) * scale
    lower = F.floor(product).cast("double")
    return product, lower, product - lower - 0.5, error


def _stepped(value: Column, places: int, product: Column, lower: Column, up: Column) -> Column:
    rounded = F.signum(value) * (lower + F.when(up, 1.0).otherwise(0.0)) / float(10**places)
    return F.when(product >= NO_FRACTION, value).otherwise(rounded)


def round_half_up(value: Column, places: int) -> Column:
    """Ties, and values spoiled out of a tie by a division, go away from zero."""
    product, lower, beyond, error = _parts(value, places)
    return _stepped(value, places, product, lower, (beyond + error) + product * TIE_SLACK >= 0)


def round_half_even(value: Column, places: int) -> Column:
    """Only exact ties go to the even digit."""
    product, lower, beyond, error = _parts(value, places)
    exact_tie = (beyond == 0) & (error == 0)
    above = (beyond > 0) | ((beyond == 0) & (error > 0))
    return _stepped(value, places, product, lower, above | (exact_tie & (lower % 2 == 1)))


def round_whole(value: Column) -> Column:
    """Nearest whole number, ties to the even one."""
    return F.rint(value).cast("long")
