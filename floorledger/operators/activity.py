"""One row per client out of several ledgers, with one shuffle instead of a join per ledger.

Slot play, table points and prizes are stacked into one narrow frame and aggregated together, so a
client that appears in only one of them needs no outer or anti join: a count of 0 says so.

Every ledger is read once, or its rollup: the same sums, kept per client and month beside a stored ledger.
Measures are sums of longs and bit sets: fixed-width buffers, so the first aggregate stays in generated
hashing that combines on the map side, which also absorbs a hot client.  Names and levels are MAX over text,
which Spark can only do by sorting; they are keys of the first aggregate, and only the few rows that it
leaves are sorted.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorledger.functions.days import bits_set, day_bit, month_number
from floorledger.functions.money import joined, millionths, whole_part
from floorledger.ledgers import Ledgers

TEXTS = ("slot_name", "player_level", "table_name")
COUNTS = ("slot_rows", "table_rows", "prize_rows", "total_games")
MONEY = ("coin_in", "promo_in", "table_coin", "prize_amount")
# Distinct days asked for -> the day columns they come from.
DAYS = {"slot_days": ("slot_day",), "table_days": ("table_day",), "any_days": ("slot_day", "table_day")}
# Months of the day columns, which only matter beside them.
MONTH_NO = "month_no"


def _money(name: str, value: Column) -> dict[str, Column]:
    """Money stays two longs until the last step: see functions.money."""
    return {f"{name}_whole": whole_part(value), f"{name}_millionths": millionths(value)}


def _contributions(ledger: str) -> dict[str, Column]:
    """What a row of a ledger adds: its client and month, texts, counts, parts of money, and its day as a bit."""
    one = F.lit(1).cast("long")
    if ledger == "play":
        return {
            "client_id": F.col("player_id"),
            MONTH_NO: month_number(F.col("gaming_date")),
            "slot_name": F.col("full_name"),
            "player_level": F.col("player_level"),
            "slot_rows": one,
            "total_games": F.col("total_games"),
            **_money("coin_in", F.col("coin_in")),
            **_money("promo_in", F.col("promo_in")),
            "slot_day": day_bit(F.col("gaming_date")),
        }
    if ledger == "points":
        return {
            "client_id": F.col("client_id"),
            MONTH_NO: month_number(F.col("op_date")),
            "table_name": F.col("client_name"),
            "table_rows": one,
            **_money("table_coin", F.col("coin_in_points")),
            "table_day": day_bit(F.col("op_date")),
        }
    return {
        "client_id": F.col("client_id"),
        "prize_rows": one,
        **_money("prize_amount", F.col("amount")),
    }


# Columns of each ledger's rollup, of which every row is a client, a month and a spelling of its texts.
ROLLUPS = {
    "play": """client_id STRING, month_no INT, slot_name STRING, player_level STRING, slot_rows BIGINT,
               total_games BIGINT, coin_in_whole BIGINT, coin_in_millionths BIGINT, promo_in_whole BIGINT,
               promo_in_millionths BIGINT, slot_day BIGINT""",
    "points": """client_id STRING, month_no INT, table_name STRING, table_rows BIGINT, table_coin_whole BIGINT,
                 table_coin_millionths BIGINT, table_day BIGINT""",
    "prizes": "client_id STRING, prize_rows BIGINT, prize_amount_whole BIGINT, prize_amount_millionths BIGINT",
}


def _is_day(name: str) -> bool:
    return name.endswith("_day")


def _added(names: Iterable[str]) -> list[Column]:
    """Aggregates of contributions, which are contributions again."""
    return [(F.bit_or(name) if _is_day(name) else F.sum(name)).alias(name) for name in names]


def rollup(rows: DataFrame, ledger: str, *keys: str) -> DataFrame:
    """The rows of a ledger added up by the given keys, client, month and texts."""
    contributions = _contributions(ledger)
    texts = [name for name in ("client_id", MONTH_NO, *TEXTS) if name in contributions]
    parts = rows.select(*keys, *[column.alias(name) for name, column in contributions.items()])
    return parts.groupBy(*keys, *texts).agg(*_added(name for name in contributions if name not in texts))


def contributions(ledgers: Ledgers | Mapping[str, DataFrame], ledger: str, *names: str) -> DataFrame:
    """Some columns of what a ledger's rows add, from its rollup where there is one; in any number of rows."""
    kept = ledgers.rollup(ledger) if isinstance(ledgers, Ledgers) else None
    if kept is not None:
        return kept.select(*names)
    columns = _contributions(ledger)
    return ledgers[ledger].select(*[columns[name].alias(name) for name in names])


def client_activity(ledgers: Ledgers | Mapping[str, DataFrame], *want: str) -> DataFrame:
    """``client_id`` and the wanted measures; sums are exact decimals, null where a ledger has no row.

    Counts (``*_rows``, ``*_days``) are 0 rather than null.  Only columns that ``want`` needs are read.
    """
    days = sorted({day for name in want for day in DAYS.get(name, ())})
    texts = [name for name in TEXTS if name in want]
    longs = [name for name in COUNTS if name in want]
    longs += [f"{name}_{part}" for name in MONEY if name in want for part in ("whole", "millionths")]
    rows = _stacked(ledgers, [*texts, *longs, *days])
    again = [*_added(longs), *[F.max(name).alias(name) for name in texts]]
    keys, month = ["client_id"], [MONTH_NO] if days else []
    first = _added([*longs, *days])
    grouped = rows.groupBy(*keys, *month, *texts).agg(*first) if first else rows.distinct()
    if texts:
        # From here on all of a client is in one place, and no further shuffle is needed.
        grouped = grouped.repartition("client_id")
    if days:
        if texts:
            grouped = grouped.groupBy(*keys, *month).agg(*again, *_added(days))
        distinct_days = [
            F.sum(bits_set(reduce(lambda a, b: a.bitwiseOR(b), [_bits(day) for day in DAYS[name]]))).alias(name)
            for name in DAYS
            if name in want
        ]
        grouped = grouped.groupBy("client_id").agg(*again, *distinct_days)
    elif texts:
        grouped = grouped.groupBy("client_id").agg(*again)
    return grouped.select("client_id", *[_result(name).alias(name) for name in want])


def _stacked(ledgers: Ledgers | Mapping[str, DataFrame], needed: list[str]) -> DataFrame:
    """The needed contributions of every ledger that has any of them, under one another."""
    parts = []
    for ledger in ROLLUPS:
        own = [name for name in needed if name in _contributions(ledger)]
        if own:
            month = [MONTH_NO] if any(map(_is_day, own)) else []
            parts.append(contributions(ledgers, ledger, "client_id", *month, *own))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _result(name: str) -> Column:
    if name in MONEY:
        return joined(F.col(f"{name}_whole"), F.col(f"{name}_millionths"))
    return F.coalesce(F.col(name), F.lit(0)) if name.endswith(("_rows", "_days")) else F.col(name)


def _bits(day: str) -> Column:
    return F.coalesce(F.col(day), F.lit(0).cast("long"))


def coin_in_of(activity: DataFrame) -> Column:
    """Slot play plus table points of a client as an exact decimal."""
    parts = [F.coalesce(F.col(c), F.lit(0)) for c in ("coin_in", "table_coin") if c in activity.columns]
    return reduce(lambda a, b: a + b, parts)
