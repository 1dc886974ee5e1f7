"""Vouchers granted on a day on which the client neither played slots nor tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorledger.functions.money import amount, or_zero, total
from floorledger.functions.text import is_blank
from floorledger.operators.facts import Facts
from floorledger.operators.filters import authorised_by
from floorledger.operators.keyfilter import filtered
from floorledger.operators.lookup import left_join, lookup_join
from floorledger.operators.names import filled_name
from floorledger.operators.ordering import ordered
from floorledger.plans.control import voucher_chart

KEYS = ["client_id", "gaming_date"]


def _active_days(facts: Facts, vouchers: DataFrame | None = None) -> DataFrame:
    """Each (client, day) with positive coin-in once, whatever its number of rows; if only days with vouchers are asked
    for, not all others."""
    slot = facts.rows["play"].where(F.col("coin_in") > 0)
    table = facts.rows["points"].where((F.col("coin_in_points") > 0) & F.col("op_date").isNotNull())
    days = slot.select(F.col("player_id").alias("client_id"), "gaming_date").unionByName(
        table.select("client_id", F.col("op_date").alias("gaming_date"))
    )
    return (days if vouchers is None else filtered(days, KEYS, vouchers)).distinct()


def zero_play_vouchers(facts: Facts, area: str = "", jefe: str = "") -> DataFrame:
    """The voucher rows themselves; an undated voucher matches no play and is kept."""
    rows = authorised_by(facts.rows["comps"], facts.ledgers.managers, area, jefe)
    active = _active_days(facts, rows).withColumn("active", F.lit(True))
    return lookup_join(rows, active, KEYS).where(F.col("active").isNull()).drop("active")


def _day_facts(facts: Facts, vouchers: DataFrame) -> DataFrame:
    """Coin-in, whether any of it was positive, and prizes per (client, day), in one shuffle.

    Only days with vouchers are asked for.  Where play is large beside the vouchers, most others are left out by a
    filter of fixed size before anything is shuffled.
    """
    slot = facts.rows["play"].select(F.col("player_id").alias("client_id"), "gaming_date", "coin_in")
    table = facts.rows["points"].where(F.col("op_date").isNotNull())
    table = table.select(
        "client_id", F.col("op_date").alias("gaming_date"), F.col("coin_in_points").alias("coin_in")
    )
    prizes = facts.rows["prizes"].select(
        *KEYS, F.lit(1).cast("long").alias("prize_rows"), F.col("amount").alias("prize_amount")
    )
    stacked = slot.unionByName(table).unionByName(prizes, allowMissingColumns=True)
    return filtered(stacked, KEYS, vouchers).groupBy(*KEYS).agg(
        total("coin_in").alias("coin"),
        F.max(F.col("coin_in") > 0).alias("active"),
        F.sum("prize_rows").alias("prize_rows"),
        total("prize_amount").alias("prize_amount"),
    )


def _zero_play(facts: Facts, keys: list[str], area: str = "", jefe: str = "") -> DataFrame:
    """Voucher groups of days without play, with coin-in, prizes and a shown name.

    Vouchers are first counted per day, client, shown name and manager, which needs no sort; only those groups
    meet the managers and are sorted for the largest name.
    """
    own_name = F.when(~is_blank(F.col("client_name")), F.col("client_name"))
    vouchers = authorised_by(facts.rows["comps"], facts.ledgers.managers, jefe=jefe)
    counted = vouchers.groupBy(*KEYS, "user_id", own_name.alias("client_name")).agg(
        F.count(F.lit(1)).alias("comp_rows"), total("amount").alias("comp_amount")
    )
    granted = [] if "user_id" in keys else [F.min("user_id").alias("user_id")]
    groups = authorised_by(counted, facts.ledgers.managers, area, jefe).groupBy(*keys).agg(
        F.max("client_name").alias("client_name"),
        *granted,
        F.sum("comp_rows").alias("comp_rows"),
        F.sum("comp_amount").alias("comp_amount"),
    )
    idle = groups.join(_day_facts(facts, vouchers), KEYS, "left").where(~F.coalesce("active", F.lit(False)))
    managers = facts.ledgers.managers.select("user_id", "name", "area")
    named = left_join(idle, managers, ["user_id"]).join(facts.history("slot_name"), "client_id", "left")
    return named.select(
        "gaming_date",
        "client_id",
        filled_name(F.col("client_name"), F.col("slot_name")).alias("client_name"),
        amount(or_zero("coin")).alias("coin_in"),
        "comp_rows",
        amount("comp_amount").alias("comp_amount"),
        or_zero("prize_rows").alias("prize_rows"),
        amount(or_zero("prize_amount")).alias("prize_amount"),
        F.coalesce("name", F.lit("")).alias("manager"),
        F.coalesce("area", F.lit("")).alias("area"),
    )


def audit_zero_play(facts: Facts, area: str = "", jefe: str = "") -> DataFrame:
    """One row per (day, client); of several managers the smallest id is shown."""
    rows = _zero_play(facts, KEYS, area, jefe).select(
        F.col("gaming_date").alias("jornada"),
        F.col("client_id").alias("cliente_id"),
        F.col("client_name").alias("nombre_cliente"),
        "coin_in",
        F.col("comp_rows").alias("cant_cortesias"),
        F.col("comp_amount").alias("monto_cortesias"),
        F.col("prize_rows").alias("cant_premios"),
        F.col("prize_amount").alias("monto_premios"),
        F.col("manager").alias("jefe_nombre"),
        F.col("area").alias("jefe_area"),
    )
    return ordered(rows, "cliente_id", F.desc("jornada"), F.desc("monto_cortesias"), "cliente_id")


def export_audit(facts: Facts) -> DataFrame:
    """One row per (day, client, manager)."""
    return _zero_play(facts, [*KEYS, "user_id"]).select(
        F.col("gaming_date").alias("Jornada"),
        F.col("client_id").alias("ID"),
        F.col("client_name").alias("Nombre"),
        F.col("coin_in").alias("Coin_In"),
        F.col("comp_rows").alias("Cortesias"),
        F.col("comp_amount").alias("Monto_Cortesias"),
        F.col("prize_rows").alias("Premios"),
        F.col("prize_amount").alias("Monto_Premios"),
        F.col("area").alias("Area"),
        F.col("manager").alias("Autorizo"),
    )


def audit_chart(facts: Facts, area: str = "") -> DataFrame:
    """Zero-play vouchers per area, or per manager of one area."""
    vouchers = facts.rows["comps"]
    groups = vouchers.groupBy(*KEYS, "user_id").agg(F.count(F.lit(1)).alias("comp_rows"))
    idle = groups.join(_active_days(facts, vouchers), KEYS, "left_anti")
    per_manager = idle.groupBy("user_id").agg(F.sum("comp_rows").alias("comp_rows"))
    return voucher_chart(per_manager, facts.ledgers.managers, area)
