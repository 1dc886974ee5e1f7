"""Cleaning of text that arrives from the feeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed around ids and names.
WHITESPACE = " \t\n\r\x0b\x0c\u00a0"

# A number as the feeds write it.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"

# Label shortening of player levels.
LONG_LEVELS = ("DREAMS ", "DREAMS")
SHORT_LEVEL = "D."


def stripped(column: Column) -> Column:
    return F.trim(column, F.lit(WHITESPACE))


def without_marks(column: Column) -> Column:
    """Remove the ``x`` marks that the prize system puts around a client id."""
    return F.trim(stripped(column), F.lit("x"))


def without_float_tail(column: Column) -> Column:
    """``17.0`` to ``17``: ids that passed through a numeric spreadsheet column."""
    return F.regexp_replace(column, "[.]0$", "")


def is_blank(column: Column) -> Column:
    return F.trim(F.coalesce(column, F.lit(""))) == ""


def or_text(column: Column, default: str) -> Column:
    """Text, or the default where it is null or empty."""
    return F.when(F.coalesce(column, F.lit("")) == "", F.lit(default)).otherwise(column)


def number_or_zero(column: Column) -> Column:
    """Text to DOUBLE; anything that is not a finite number counts as 0."""
    parsed = F.when(column.rlike(NUMBER_PATTERN), column.try_cast("double"))
    return F.when(F.abs(parsed) < float("inf"), parsed).otherwise(F.lit(0.0))


def level_label(column: Column) -> Column:
    """Short form of a player level for narrow tables."""
    for long_level in LONG_LEVELS:
        column = F.replace(column, F.lit(long_level), F.lit(SHORT_LEVEL))
    return column
