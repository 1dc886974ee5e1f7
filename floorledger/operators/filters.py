"""Period and authoriser filters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorledger.ledgers import MONTH_COLUMN
from floorledger.operators.lookup import semi_join


def _is_period(anio: str, mes: str) -> bool:
    """Whether the texts name a four-digit year and a two-digit month; either may be empty."""
    return bool(re.fullmatch(r"((?!0000)\d{4})?", anio) and re.fullmatch(r"(0[1-9]|1[0-2])?", mes))


def _in_months(anio: str, mes: str) -> Column:
    """The period as a condition on the month partitions of a stored ledger."""
    stored = F.col(MONTH_COLUMN)
    if anio and mes:
        return stored == f"{anio}-{mes}"
    if anio:
        return stored.between(f"{anio}-01", f"{anio}-12")
    return F.substring(stored, 6, 2) == mes


def stored_period(df: DataFrame, anio: str | None = "", mes: str | None = "") -> DataFrame:
    """Months of a rollup in the period, by partition alone; all, undated rows too, without a period."""
    if not anio and not mes:
        return df
    return df.where(_in_months(anio or "", mes or "") if _is_period(anio or "", mes or "") else F.lit(False))


def period(df: DataFrame, day: str, anio: str | None = "", mes: str | None = "") -> DataFrame:
    """Rows of a year, of a month of every year, or of one month; null days pass only without a period.

    ``anio`` is a four-digit text and ``mes`` a two-digit one; any other text matches nothing.  A year
    becomes a half-open range on the day, which reaches the Parquet scan; on a stored ledger the same
    period also prunes month partitions.
    """
    if not anio and not mes:
        return df
    if not _is_period(anio or "", mes or ""):
        return df.where(F.lit(False))
    if anio:
        first = f"{anio}-{mes or '01'}-01"
        last_month = int(mes or 12)
        past_end = f"{int(anio) + 1:04d}-01-01" if last_month == 12 else f"{anio}-{last_month + 1:02d}-01"
        wanted = (F.col(day) >= F.lit(first).cast("date")) & (F.col(day) < F.lit(past_end).cast("date"))
    else:
        wanted = F.month(day) == int(mes)
    if MONTH_COLUMN in df.columns:
        wanted = _in_months(anio or "", mes or "") & wanted
    return df.where(wanted)


def with_area(managers: DataFrame) -> DataFrame:
    return managers.where(F.col("area").isNotNull() & (F.col("area") != ""))


def authorised_by(comps: DataFrame, managers: DataFrame, area: str | None = "", jefe: str | None = "") -> DataFrame:
    """Vouchers of one manager, else of the managers of an area, else all.

    Managers are broadcast where the planner finds them small enough; beyond that, the vouchers of a manager
    who granted very many are spread over tasks.
    """
    if jefe:
        return comps.where(F.col("user_id") == jefe)
    if area:
        return semi_join(comps, managers.where(F.col("area") == area), ["user_id"])
    return comps
