"""Order of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed value: text sorts by the rules of this language.
TEXT_COLLATION = "es"


def ordered(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """Global order of a report whose last step is a join or an aggregate.

    A range sort samples its input before it shuffles it, which would run that last step twice.  The
    finished rows, far fewer than what they were made of, are first written to an evenly sized shuffle
    on their own key, so that sampling reads those.
    """
    return df.hint("rebalance", key).orderBy(*order)


def sort_report(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Order by one column: numbers and days by value, text as a Spanish dictionary would."""
    key = F.col(column)
    if isinstance(df.schema[column].dataType, StringType):
        key = F.collate(key, TEXT_COLLATION)
    return ordered(df, df.columns[0], key.asc() if ascending else key.desc())
