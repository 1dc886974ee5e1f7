"""What the reports of one period share: filtered ledgers and the aggregates built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorledger.functions.days import bits_set
from floorledger.functions.money import joined, total
from floorledger.ledgers import DAY_COLUMN, Ledgers
from floorledger.operators.activity import MONTH_NO, client_activity, contributions
from floorledger.operators.filters import authorised_by, period, stored_period

# Measures of one client that more than one export section reads.
CLIENT_MEASURES = (
    "slot_rows", "slot_name", "player_level", "coin_in", "promo_in", "total_games", "slot_days",
    "table_rows", "table_name", "table_coin", "table_days", "any_days", "prize_rows", "prize_amount",
)
VOUCHER_KEYS = ("client_id", "client_name", "user_id")


class Facts:
    """Ledgers cut to a period.  Building frames runs nothing."""

    def __init__(self, ledgers: Ledgers, anio: str | None = "", mes: str | None = "") -> None:
        self.ledgers = ledgers
        self.anio, self.mes = anio or "", mes or ""
        self.rows = ledgers.replaced() if self.whole_history else Ledgers(self._cut, self._cut_rollup)
        self._clients: DataFrame | None = None
        self._vouchers: DataFrame | None = None

    def _cut(self, name: str) -> DataFrame:
        return period(self.ledgers[name], DAY_COLUMN[name], self.anio, self.mes)

    def _cut_rollup(self, name: str) -> DataFrame | None:
        kept = self.ledgers.rollup(name)
        return None if kept is None else stored_period(kept, self.anio, self.mes)

    @property
    def whole_history(self) -> bool:
        return not self.anio and not self.mes

    def clients(self, *want: str) -> DataFrame:
        """Activity per client in the period, with the wanted measures."""
        if self._clients is not None:
            return self._clients.select("client_id", *want)
        return client_activity(self.rows, *want)

    def history(self, *want: str) -> DataFrame:
        """Activity per client over all periods; a stored ledger gives it from its rollup."""
        if self.whole_history:
            return self.clients(*want)
        return client_activity(self.ledgers, *want)

    def vouchers(self, *keys: str, area: str | None = "", jefe: str | None = "") -> DataFrame:
        """Voucher count and exact amount per key, after the manager or area filter."""
        groups = self._vouchers
        if groups is None:
            # With an area, vouchers are grouped by manager too, so that groups and not vouchers meet the managers.
            grain = dict.fromkeys([*keys, "user_id"] if area and not jefe else keys)
            rows = authorised_by(self.rows["comps"], self.ledgers.managers, jefe=jefe)
            groups = rows.groupBy(*grain).agg(
                F.count(F.lit(1)).alias("comp_rows"), total("amount").alias("comp_amount")
            )
            if not area or jefe:
                return groups
        rows = authorised_by(groups, self.ledgers.managers, area, jefe)
        return rows.groupBy(*keys).agg(
            F.sum("comp_rows").alias("comp_rows"), F.sum("comp_amount").alias("comp_amount")
        )

    def _parts(self, *ledgers: str) -> DataFrame:
        """Coin-in of the named ledgers in its two parts, and their days as bits of a month."""
        names = {
            "play": ("coin_in_whole", "coin_in_millionths", MONTH_NO, "slot_day"),
            "points": ("table_coin_whole", "table_coin_millionths", MONTH_NO, "table_day"),
        }
        parts = [contributions(self.rows, name, *names[name]).toDF("whole", "parts", MONTH_NO, "days") for name in ledgers]
        return reduce(DataFrame.unionByName, parts)

    def coin_in_total(self, *ledgers: str) -> DataFrame:
        """One row: exact coin-in of the named ledgers."""
        coin = joined(F.sum("whole"), F.sum("parts"))
        return self._parts(*ledgers).agg(F.coalesce(coin, F.lit(0)).alias("period_coin_in"))

    def period_total(self, *ledgers: str) -> DataFrame:
        """One row: exact coin-in and distinct days of the named ledgers, in one scan of each."""
        months = self._parts(*ledgers).groupBy(MONTH_NO).agg(
            F.sum("whole").alias("whole"), F.sum("parts").alias("parts"), F.bit_or("days").alias("days")
        )
        coin = joined(F.sum("whole"), F.sum("parts"))
        return months.agg(F.coalesce(coin, F.lit(0)).alias("period_coin_in"), _distinct_days().alias("period_days"))

    def day_total(self, *ledgers: str) -> DataFrame:
        """One row: distinct days of the named ledgers, 1 if there are none."""
        months = self._parts(*ledgers).groupBy(MONTH_NO).agg(F.bit_or("days").alias("days"))
        return months.agg(_distinct_days().alias("period_days"))

    def resting_on(self, clients: DataFrame, vouchers: DataFrame) -> Facts:
        """The same facts, with the activity of ``CLIENT_MEASURES`` and the groups of ``VOUCHER_KEYS`` given."""
        given = Facts(self.ledgers, self.anio, self.mes)
        given._clients, given._vouchers = clients, vouchers
        return given


def _distinct_days() -> Column:
    """Days of all months together, 1 if there are none."""
    days = F.coalesce(F.sum(bits_set(F.col("days"))), F.lit(0)).cast("long")
    return F.when(days == 0, F.lit(1).cast("long")).otherwise(days)


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of an ungrouped aggregate, which always is exactly one row, beside every row."""
    return df.crossJoin(F.broadcast(one_row))
