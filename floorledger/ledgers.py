"""The six canonical tables every report reads."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

PLAY = """gaming_date DATE, player_id STRING, full_name STRING, player_level STRING,
          coin_in DOUBLE, total_games BIGINT, promo_in DOUBLE"""
COMPS = """gaming_date DATE, client_id STRING, client_name STRING, category STRING, product STRING,
           amount DOUBLE, status STRING, user_id STRING, user_name STRING"""
PRIZES = "gaming_date DATE, client_id STRING, amount DOUBLE, pay_type STRING"
POINTS = "op_date DATE, client_id STRING, client_name STRING, points DOUBLE, coin_in_points DOUBLE"
MANAGERS = "user_id STRING, name STRING, area STRING"
TIERS = "category STRING, pct DOUBLE"
SCHEMAS = {
    "play": PLAY,
    "comps": COMPS,
    "prizes": PRIZES,
    "points": POINTS,
    "managers": MANAGERS,
    "tiers": TIERS,
}

# The column that tells rows of a dimension apart.
KEY_COLUMN = {"managers": "user_id", "tiers": "category"}

# The column each ledger is dated by.
DAY_COLUMN = {"play": "gaming_date", "comps": "gaming_date", "prizes": "gaming_date", "points": "op_date"}

# Partition column of a stored ledger: yyyy-MM, or UNDATED where the day is null.
MONTH_COLUMN = "ledger_month"
UNDATED = "undated"


class Ledgers:
    """The six frames by name, from a mapping or from a function that is asked once per name.

    ``rollups`` gives what is kept per client and month of a stored ledger, or None; see ``operators.activity``.
    """

    def __init__(
        self,
        source: Mapping[str, DataFrame] | Callable[[str], DataFrame],
        rollups: Callable[[str], DataFrame | None] = lambda name: None,
    ) -> None:
        self._source = source if callable(source) else source.__getitem__
        self._frames: dict[str, DataFrame] = {}
        self.rollup = rollups

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._source(name)
        return self._frames[name]

    def replaced(self, **frames: DataFrame) -> Ledgers:
        """The same ledgers with some frames exchanged."""
        rollups = lambda name: None if name in frames else self.rollup(name)
        return Ledgers(lambda name: frames[name] if name in frames else self[name], rollups)

    play = property(lambda self: self["play"])
    comps = property(lambda self: self["comps"])
    prizes = property(lambda self: self["prizes"])
    points = property(lambda self: self["points"])
    managers = property(lambda self: self["managers"])
    tiers = property(lambda self: self["tiers"])
