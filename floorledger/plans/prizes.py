"""Hand-paid prizes: per player, pay type, day, and in total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorledger.functions.money import amount, or_zero, pct_half_up, share_pct, total
from floorledger.operators.activity import coin_in_of
from floorledger.operators.facts import Facts, with_scalar
from floorledger.operators.ordering import ordered
from floorledger.operators.names import NO_NAME
from floorledger.plans.comps import NO_LEVEL


def _per_player(facts: Facts, *extra: str) -> DataFrame:
    want = ("prize_rows", "prize_amount", "slot_name", "table_name", "player_level", "coin_in", "table_coin", *extra)
    return facts.clients(*want).where(F.col("prize_rows") > 0)


def _name() -> Column:
    return F.coalesce("slot_name", "table_name", F.lit(NO_NAME))


def prizes_by_player(facts: Facts) -> DataFrame:
    rows = _per_player(facts, "promo_in", "total_games")
    coin_in = amount(coin_in_of(rows))
    won = amount("prize_amount")
    shown = rows.select(
        F.col("client_id").alias("cliente_id"),
        _name().alias("nombre"),
        F.coalesce("player_level", F.lit(NO_LEVEL)).alias("player_level"),
        F.col("prize_rows").alias("total_premios"),
        won.alias("monto_total"),
        coin_in.alias("total_coin_in"),
        amount(or_zero("promo_in")).alias("total_promo_in"),
        or_zero("total_games").alias("total_games"),
        pct_half_up(won, coin_in, 4).alias("pct_premio_coin_in"),
    )
    return ordered(shown, "cliente_id", F.desc("monto_total"), "cliente_id")


def export_prizes(facts: Facts) -> DataFrame:
    rows = _per_player(facts)
    return rows.select(
        F.col("client_id").alias("ID"),
        _name().alias("Nombre"),
        F.coalesce("player_level", F.lit(NO_LEVEL)).alias("Nivel"),
        F.col("prize_rows").alias("Total_Premios"),
        amount("prize_amount").alias("Monto_Premios"),
        amount(coin_in_of(rows)).alias("Coin_In"),
    )


def prizes_by_type(facts: Facts) -> DataFrame:
    """With each pay type's share of the whole amount."""
    prizes = facts.rows["prizes"]
    groups = prizes.groupBy(F.col("pay_type").alias("tipo_pago")).agg(
        F.count(F.lit(1)).alias("cantidad"), total("amount").alias("monto")
    )
    return (
        with_scalar(groups, groups.agg(F.sum("monto").alias("todo"), F.sum("cantidad").alias("filas")))
        .select(
            "tipo_pago",
            "cantidad",
            amount("monto").alias("monto_total"),
            share_pct(amount("monto"), amount("todo"), F.col("filas")).alias("pct_total"),
        )
        .orderBy(F.desc("monto_total"), "tipo_pago")
    )


def prize_types_all(facts: Facts) -> DataFrame:
    return (
        facts.rows["prizes"]
        .groupBy(F.col("pay_type").alias("tipo"))
        .agg(F.count(F.lit(1)).alias("cantidad"), amount(total("amount")).alias("monto"))
        .orderBy(F.desc("monto"), "tipo")
    )


def prizes_by_day(facts: Facts) -> DataFrame:
    return (
        facts.rows["prizes"]
        .where(F.col("gaming_date").isNotNull())
        .groupBy(F.col("gaming_date").alias("fecha_jornada"))
        .agg(F.count(F.lit(1)).alias("cantidad"), amount(total("amount")).alias("monto_total"))
        .orderBy("fecha_jornada")
    )


def prizes_totals(facts: Facts) -> DataFrame:
    return facts.rows["prizes"].agg(
        F.count(F.lit(1)).alias("total_premios"),
        amount(total("amount")).alias("monto_total"),
        F.count_distinct("client_id").alias("clientes_unicos"),
    )
