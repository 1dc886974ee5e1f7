"""Filter choices, row counts and period labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorledger.functions.days import period_label
from floorledger.ledgers import DAY_COLUMN, MONTH_COLUMN, UNDATED, Ledgers
from floorledger.operators.filters import with_area


def _months(ledgers: Ledgers) -> DataFrame:
    """Distinct (year, month) texts of the four ledgers; a stored ledger has them as partition values, so that no
    column of it is read."""
    parts = [_month_texts(ledgers[name], day) for name, day in DAY_COLUMN.items()]
    months = reduce(DataFrame.unionByName, parts).distinct()
    return months.select(F.split_part("month", F.lit("-"), F.lit(1)).alias("anio"), F.split_part("month", F.lit("-"), F.lit(2)).alias("mes"))


def _month_texts(ledger: DataFrame, day: str) -> DataFrame:
    if MONTH_COLUMN in ledger.columns:
        return ledger.where(F.col(MONTH_COLUMN) != UNDATED).select(F.col(MONTH_COLUMN).alias("month")).distinct()
    days = ledger.where(F.col(day).isNotNull()).select(F.trunc(day, "month").alias("first")).distinct()
    return days.select(F.date_format("first", "yyyy-MM").alias("month"))


def filter_years(ledgers: Ledgers) -> DataFrame:
    return _months(ledgers).select("anio").distinct().orderBy("anio")


def filter_months(ledgers: Ledgers) -> DataFrame:
    return _months(ledgers).select("mes").distinct().orderBy("mes")


def filter_areas(ledgers: Ledgers) -> DataFrame:
    return with_area(ledgers.managers).select("area").distinct().orderBy("area")


def filter_managers(ledgers: Ledgers, area: str = "") -> DataFrame:
    managers = ledgers.managers.where(F.col("area") == area) if area else ledgers.managers
    return managers.select(F.col("user_id").alias("usuario_id"), F.col("name").alias("nombre")).orderBy("nombre")


def period_labels(ledgers: Ledgers) -> DataFrame:
    """The label of every period one can choose: each month, each year, each month of all years, all."""
    choices = F.array(
        *[
            F.struct(year.alias("anio"), month.alias("mes"))
            for year in (F.col("anio"), F.lit(""))
            for month in (F.col("mes"), F.lit(""))
        ]
    )
    return (
        _months(ledgers)
        .select(F.inline(choices))
        .distinct()
        .select("anio", "mes", period_label(F.col("anio"), F.col("mes")).alias("periodo"))
        .orderBy("anio", "mes")
    )


def table_counts(ledgers: Ledgers) -> DataFrame:
    counts = [
        ledgers[name].agg(F.count(F.lit(1)).alias("cnt")).select(F.lit(name).alias("tabla"), "cnt")
        for name in DAY_COLUMN
    ]
    return reduce(DataFrame.unionByName, counts)
