"""Invitation controls: what a client may receive against what was given.

allowance = coin-in * base rate * rate of the client's level; balance = allowance - vouchers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorledger.functions.money import amount, or_zero, pct_half_even, total
from floorledger.functions.rounding import round_whole
from floorledger.functions.text import or_text
from floorledger.operators.activity import coin_in_of
from floorledger.operators.facts import Facts, with_scalar
from floorledger.operators.filters import with_area
from floorledger.operators.ordering import ordered

# The base-rate row of the tiers, the two gaming areas, the level of table players.
BASE_TIER = "Primario"
SLOT_AREA, TABLE_AREA = "MDA", "MDJ"
TABLE_LEVEL = "MDJ"
NO_LABEL = "Sin asignar"
# A pie slice carries its own label above this share.
LABELLED_SHARE = 0.05


def base_rate(tiers: DataFrame) -> DataFrame:
    """One row: the base rate, 0 if there is none."""
    return tiers.where(F.col("category") == BASE_TIER).agg(or_zero(F.max("pct")).alias("pct_primario"))


def allowance(players: DataFrame, facts: Facts, days: DataFrame) -> DataFrame:
    """Add rates, allowance and balance.

    ``players`` has ``client_id, segmento, nombre, nivel, dias, coin, comp_rows, comp_amount,
    prize_rows, prize_amount``; only its own copy of the level is used for the rate lookup.
    """
    tiers = facts.ledgers.tiers
    rates = tiers.where(F.col("category") != BASE_TIER).select(
        F.col("category").alias("rate_level"), F.col("pct").alias("rate")
    )
    rated = players.join(rates, F.col("nivel") == F.col("rate_level"), "left")
    rated = reduce(with_scalar, [base_rate(tiers), days], rated)
    pct_cat = F.coalesce("rate", F.lit(0.0))
    coin, spent = amount(or_zero("coin")), amount("comp_amount")
    invited = coin * F.col("pct_primario") * pct_cat
    return rated.select(
        *players.columns,
        pct_cat.alias("pct_cat"),
        coin.alias("coin_in"),
        spent.alias("micros"),
        round_whole(invited).alias("invitacion"),
        round_whole(invited - spent).alias("saldo"),
        pct_half_even(F.col("dias").cast("double"), F.col("period_days").cast("double"), 1).alias("asistencia"),
    )


def _all_players(facts: Facts) -> DataFrame:
    """Slot players (segment 0), then clients seen only at the tables (segment 1)."""
    seen = facts.clients(
        "slot_rows", "slot_name", "player_level", "coin_in", "any_days",
        "table_rows", "table_name", "table_coin", "prize_rows", "prize_amount",
    ).where((F.col("slot_rows") > 0) | (F.col("table_rows") > 0))
    slot = F.col("slot_rows") > 0
    return seen.select(
        "client_id",
        F.when(slot, 0).otherwise(1).alias("segmento"),
        F.when(slot, F.col("slot_name")).otherwise(F.col("table_name")).alias("nombre"),
        F.when(slot, F.col("player_level")).otherwise(F.lit(TABLE_LEVEL)).alias("nivel"),
        F.col("any_days").alias("dias"),
        coin_in_of(seen).alias("coin"),
        "prize_rows",
        "prize_amount",
    )


def _slot_players(facts: Facts) -> DataFrame:
    seen = facts.clients(
        "slot_rows", "slot_name", "player_level", "coin_in", "slot_days", "prize_rows", "prize_amount"
    ).where(F.col("slot_rows") > 0)
    return seen.select(
        "client_id",
        F.lit(0).alias("segmento"),
        F.col("slot_name").alias("nombre"),
        F.col("player_level").alias("nivel"),
        F.col("slot_days").alias("dias"),
        F.col("coin_in").alias("coin"),
        "prize_rows",
        "prize_amount",
    )


def _table_players(facts: Facts) -> DataFrame:
    """Levels come from all of slot play, whatever the period."""
    play = ("table_rows", "table_name", "table_coin", "table_days", "prize_rows", "prize_amount")
    if facts.whole_history:
        seen = facts.clients(*play, "player_level")
    else:
        seen = facts.clients(*play).join(facts.history("player_level"), "client_id", "left")
    return seen.where(F.col("table_rows") > 0).select(
        "client_id",
        F.lit(0).alias("segmento"),
        F.col("table_name").alias("nombre"),
        F.coalesce("player_level", F.lit(TABLE_LEVEL)).alias("nivel"),
        F.col("table_days").alias("dias"),
        F.col("table_coin").alias("coin"),
        "prize_rows",
        "prize_amount",
    )


def control_rows(facts: Facts, area: str = "", jefe: str = "") -> DataFrame:
    """Allowance rows of the combined control, with client id and segment, unordered."""
    players = _all_players(facts).join(facts.vouchers("client_id", area=area, jefe=jefe), "client_id")
    return allowance(
        players.withColumn("nivel", F.coalesce("nivel", F.lit(""))), facts, facts.day_total("play", "points")
    )


def _shown(rows: DataFrame, *more: str) -> DataFrame:
    return ordered(rows, "client_id", "segmento", F.desc("coin_in"), "client_id").select(
        "nombre",
        "nivel",
        F.col("dias").alias("dias_asistidos"),
        F.col("asistencia").alias("pct_asistencia"),
        F.col("prize_rows").alias("cant_premios"),
        amount(or_zero("prize_amount")).alias("monto_premios"),
        F.col("coin_in").alias("coin_in_mensual"),
        F.col("comp_rows").alias("total_cortesias"),
        F.col("micros").alias("monto_micros"),
        F.col("invitacion").alias("invitacion_mensual"),
        "saldo",
        *more,
    )


def control_all(facts: Facts, area: str = "", jefe: str = "") -> DataFrame:
    return _shown(control_rows(facts, area, jefe), "pct_cat")


def control_slots(facts: Facts, jefe: str = "") -> DataFrame:
    vouchers = facts.vouchers("client_id", area=SLOT_AREA, jefe=jefe)
    players = _slot_players(facts).join(vouchers, "client_id")
    rows = players.withColumn("nivel", F.coalesce("nivel", F.lit("")))
    return _shown(allowance(rows, facts, facts.day_total("play")))


def control_tables(facts: Facts, jefe: str = "") -> DataFrame:
    vouchers = facts.vouchers("client_id", area=TABLE_AREA, jefe=jefe)
    players = _table_players(facts).join(vouchers, "client_id")
    rows = players.withColumn("nivel", or_text(F.col("nivel"), TABLE_LEVEL))
    return _shown(allowance(rows, facts, facts.day_total("points")))


def _exported(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.select(
        "segmento",
        "client_id",
        F.col("nombre").alias("Nombre"),
        F.col("nivel").alias("Nivel"),
        F.col("dias").alias("Dias"),
        F.col("asistencia").alias("Pct_Asistencia"),
        F.col("prize_rows").alias("Premios"),
        amount(or_zero("prize_amount")).alias("Monto_Premios"),
        F.col("coin_in").alias("Coin_In"),
        F.col("invitacion").alias("Invitacion_Max"),
        F.col("comp_rows").alias("Cortesias_Cant"),
        F.col("micros").alias("Cortesias_Monto"),
        F.col("saldo").alias("Saldo"),
        *more,
    )


def export_control(facts: Facts) -> DataFrame:
    """One row per client and granting manager; coin-in and allowance repeat on each of them."""
    managers = facts.ledgers.managers.select("user_id", "name", "area")
    vouchers = facts.vouchers("client_id", "user_id").join(managers, "user_id", "left")
    rows = allowance(_all_players(facts).join(vouchers, "client_id"), facts, facts.day_total("play", "points"))
    return _exported(
        rows, F.coalesce("area", F.lit("")).alias("Area"), F.coalesce("name", F.lit("")).alias("Autorizo")
    )


def export_slots(facts: Facts) -> DataFrame:
    players = _slot_players(facts).join(facts.vouchers("client_id", area=SLOT_AREA), "client_id")
    return _exported(allowance(players, facts, facts.day_total("play")))


def export_tables(facts: Facts) -> DataFrame:
    players = _table_players(facts).join(facts.vouchers("client_id", area=TABLE_AREA), "client_id")
    return _exported(allowance(players, facts, facts.day_total("points")))


def voucher_chart(vouchers: DataFrame, managers: DataFrame, area: str = "") -> DataFrame:
    """Voucher count per area, or per manager of one area, with the share of each slice.

    ``vouchers`` is already counted per ``user_id`` (column ``comp_rows``), so a manager who granted a
    third of all vouchers is one row here.
    """
    chosen = managers.where(F.col("area") == area) if area else with_area(managers)
    label = F.col("name") if area else F.col("area")
    slices = (
        vouchers.join(chosen, "user_id")
        .groupBy(label.alias("label"))
        .agg(F.sum("comp_rows").alias("cantidad"))
    )
    whole = slices.agg(F.sum("cantidad").alias("todo"))
    share = F.col("cantidad") / F.col("todo")
    return (
        with_scalar(slices, whole)
        .select(
            or_text(F.col("label"), NO_LABEL).alias("etiqueta"),
            "cantidad",
            (share * 100.0).alias("pct"),
            (share > LABELLED_SHARE).alias("rotulado"),
        )
        .orderBy(F.desc("cantidad"), "etiqueta")
    )


def control_chart(facts: Facts, area: str = "") -> DataFrame:
    """All vouchers of the period: no manager filter here."""
    return voucher_chart(facts.vouchers("user_id"), facts.ledgers.managers, area)


def _kpis(facts: Facts, *ledgers: str) -> DataFrame:
    comps = facts.rows["comps"].agg(or_zero(total("amount")).alias("comps"))
    one = reduce(
        with_scalar,
        [facts.period_total(*ledgers), comps, base_rate(facts.ledgers.tiers)],
    )
    given, coin_in = amount("comps"), amount("period_coin_in")
    return one.select(
        given.alias("total_cortesias_periodo"),
        coin_in.alias("total_coin_in_periodo"),
        pct_half_even(given, coin_in, 3).alias("pct_cortesias_coin_in"),
        F.col("period_days").alias("dias_totales"),
        "pct_primario",
    )


def control_kpis(facts: Facts) -> DataFrame:
    """Totals of the period; neither the area nor the manager filter applies to them."""
    return _kpis(facts, "play", "points")


def control_slots_kpis(facts: Facts) -> DataFrame:
    return _kpis(facts, "play")


def control_tables_kpis(facts: Facts) -> DataFrame:
    return _kpis(facts, "points")
