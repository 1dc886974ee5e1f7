"""Gaming days, calendar names and distinct-day counting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday names, Monday first, and month names, January first.
WEEKDAYS = ("Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado", "Domingo")
MONTHS = (
    "Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio",
    "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre",
)
EVERY = "Todos"

# Fixed value: the gaming day starts at this local hour.
DAY_START_HOUR = 9

ISO_DAY = r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?)?$"
NUMBERED_DAY = r"^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})$"
DAY_FIRST_MINUTE = r"^([0-9]{1,2})-([0-9]{1,2})-([0-9]{4}) ([0-9]{1,2}):([0-9]{1,2})$"


def gaming_day(timestamp: Column) -> Column:
    """Day a naive timestamp belongs to: 08:59 is still the previous day."""
    return F.to_date(timestamp - F.make_dt_interval(hours=F.lit(DAY_START_HOUR)))


def parse_day(text: Column, day_first: bool = False) -> Column:
    """Day from ``yyyy-MM-dd`` with or without a time, or from three numbers with ``/`` or ``-``; else null.

    ``03/04/2024`` is 4 March, as the feeds have always been read, or with ``day_first`` 3 April.
    """
    iso = F.when(text.rlike(ISO_DAY), text.try_cast("timestamp_ntz"))
    order = "$3-$2-$1" if day_first else "$3-$1-$2"
    numbered = F.when(text.rlike(NUMBERED_DAY), F.regexp_replace(text, NUMBERED_DAY, order).try_cast("date"))
    return F.coalesce(F.to_date(iso), numbered)


def parse_minute(text: Column) -> Column:
    """Naive timestamp from ``dd-MM-yyyy HH:mm`` (leading zeros optional); else null."""
    iso = F.regexp_replace(text, DAY_FIRST_MINUTE, "$3-$2-$1 $4:$5")
    return F.when(text.rlike(DAY_FIRST_MINUTE), iso.try_cast("timestamp_ntz"))


def weekday_name(day: Column) -> Column:
    """Spanish weekday name, empty for a null day."""
    names = F.array(*[F.lit(name) for name in WEEKDAYS])
    return F.when(day.isNull(), F.lit("")).otherwise(F.element_at(names, F.weekday(day) + 1))


def month_name(month: Column) -> Column:
    """``03`` to ``Marzo``; a text that is no month passes through."""
    names = F.create_map(*[F.lit(part) for i, name in enumerate(MONTHS, 1) for part in (f"{i:02d}", name)])
    return F.coalesce(F.try_element_at(names, month), month)


def period_label(year: Column, month: Column) -> Column:
    """``1997-Marzo``; an unset year or month reads ``Todos``."""
    year_part = F.when(F.coalesce(year, F.lit("")) == "", F.lit(EVERY)).otherwise(year)
    month_part = F.when(F.coalesce(month, F.lit("")) == "", F.lit(EVERY)).otherwise(month_name(month))
    return F.concat_ws("-", year_part, month_part)


def month_number(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def day_bit(day: Column) -> Column:
    """A day of its month as one bit of a long.

    Put together by client and month, this replaces a shuffle of every (client, day) pair by one long per
    (client, month) that combines on the map side.
    """
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.dayofmonth(day))


def bits_set(bits: Column) -> Column:
    return F.coalesce(F.bit_count(bits), F.lit(0))
