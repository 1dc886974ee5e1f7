"""Vouchers: per player, category, product, day, and in total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorledger.functions.days import weekday_name
from floorledger.functions.money import amount, or_zero, pct_half_up, share_pct, total
from floorledger.operators.activity import coin_in_of
from floorledger.operators.facts import Facts, with_scalar
from floorledger.operators.filters import authorised_by
from floorledger.operators.lookup import left_join
from floorledger.operators.names import filled_name
from floorledger.operators.ordering import ordered

# Fixed value: shown for a client without a player level.
NO_LEVEL = "-"


def _per_player(facts: Facts, *extra: str) -> DataFrame:
    """Voucher groups per client and shown name, beside the client's play."""
    play = ("coin_in", "table_coin", "player_level", *extra)
    groups = facts.vouchers("client_id", "client_name")
    if facts.whole_history:
        joined = groups.join(facts.clients(*play, "slot_name"), "client_id", "left")
    else:
        # Names come from all of play, the measures only from the period.
        joined = groups.join(facts.clients(*play), "client_id", "left")
        joined = joined.join(facts.history("slot_name"), "client_id", "left")
    shown = filled_name(F.col("client_name"), F.col("slot_name"))
    # All of a client's blank spellings show one name, so they become one row.
    return joined.groupBy("client_id", shown.alias("nombre_cliente")).agg(
        F.sum("comp_rows").alias("total_cortesias"),
        F.sum("comp_amount").alias("comp_amount"),
        *[F.max(name).alias(name) for name in play],
    )


def comps_by_player(facts: Facts) -> DataFrame:
    rows = _per_player(facts, "promo_in", "total_games")
    coin_in = amount(coin_in_of(rows))
    spent = amount("comp_amount")
    shown = rows.select(
        F.col("client_id").alias("cliente_id"),
        "nombre_cliente",
        "total_cortesias",
        spent.alias("monto_cortesias"),
        coin_in.alias("total_coin_in"),
        amount(or_zero("promo_in")).alias("total_promo_in"),
        or_zero("total_games").alias("total_games"),
        F.coalesce("player_level", F.lit(NO_LEVEL)).alias("player_level"),
        pct_half_up(spent, coin_in, 4).alias("pct_cortesia_coin_in"),
    )
    return ordered(shown, "cliente_id", F.desc("monto_cortesias"), "cliente_id")


def export_comps(facts: Facts) -> DataFrame:
    rows = _per_player(facts)
    coin_in = amount(coin_in_of(rows))
    spent = amount("comp_amount")
    return rows.select(
        F.col("client_id").alias("ID"),
        F.col("nombre_cliente").alias("Nombre"),
        F.col("total_cortesias").alias("Cortesias"),
        spent.alias("Monto_Cortesias"),
        coin_in.alias("Coin_In"),
        F.coalesce("player_level", F.lit(NO_LEVEL)).alias("Nivel"),
        pct_half_up(spent, coin_in, 4).alias("Pct_Cortesia_CoinIn"),
    )


def _grouped(facts: Facts, *keys: str) -> DataFrame:
    return facts.rows["comps"].groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cantidad"), total("amount").alias("monto")
    )


def comps_by_category(facts: Facts) -> DataFrame:
    """With each category's share of the whole amount."""
    groups = _grouped(facts, F.col("category").alias("descripcion_cat"))
    whole = groups.agg(F.sum("monto").alias("todo"), F.sum("cantidad").alias("filas"))
    return (
        with_scalar(groups, whole)
        .select(
            "descripcion_cat",
            "cantidad",
            amount("monto").alias("monto_total"),
            share_pct(amount("monto"), amount("todo"), F.col("filas")).alias("pct_total"),
        )
        .orderBy(F.desc("monto_total"), "descripcion_cat")
    )


def _products(facts: Facts) -> DataFrame:
    return _grouped(facts, F.col("category").alias("descripcion_cat"), F.col("product").alias("descripcion_prod"))


def comps_by_product(facts: Facts) -> DataFrame:
    """With each product's share of its category.

    The category amount is joined back rather than taken over a window, so that a category with very
    many products is not one task.
    """
    products = _products(facts)
    categories = products.groupBy(F.col("descripcion_cat").alias("cat")).agg(
        F.sum("monto").alias("todo"), F.sum("cantidad").alias("filas")
    )
    rows = products.join(categories, F.col("descripcion_cat").eqNullSafe(F.col("cat"))).select(
        "descripcion_cat",
        "descripcion_prod",
        "cantidad",
        amount("monto").alias("monto_total"),
        share_pct(amount("monto"), amount("todo"), F.col("filas")).alias("pct_categoria"),
    )
    return ordered(rows, "descripcion_prod", "descripcion_cat", F.desc("monto_total"), "descripcion_prod")


def comps_products_nested(facts: Facts) -> DataFrame:
    """The products of each category, dearest first: one row per product at any size.

    Rows rather than arrays, so that a category with very many products is neither one row nor one task.
    """
    rows = _products(facts).select("descripcion_cat", "descripcion_prod", "cantidad", amount("monto").alias("monto_total"))
    return ordered(rows, "descripcion_prod", "descripcion_cat", F.desc("monto_total"), "descripcion_prod")


def comps_by_day(facts: Facts) -> DataFrame:
    """Days with vouchers, with the slot and table coin-in of the same day."""
    comps = facts.rows["comps"].where(F.col("gaming_date").isNotNull())
    days = comps.groupBy(F.col("gaming_date").alias("fecha_jornada")).agg(
        F.count(F.lit(1)).alias("cantidad"), total("amount").alias("monto")
    )
    slot = facts.rows["play"].groupBy(F.col("gaming_date").alias("fecha_jornada")).agg(total("coin_in").alias("mda"))
    table = facts.rows["points"].groupBy(F.col("op_date").alias("fecha_jornada")).agg(
        total("coin_in_points").alias("mdy")
    )
    return (
        days.join(slot, "fecha_jornada", "left")
        .join(table, "fecha_jornada", "left")
        .select(
            "fecha_jornada",
            "cantidad",
            amount("monto").alias("monto_total"),
            weekday_name(F.col("fecha_jornada")).alias("dia_semana"),
            amount(or_zero("mda")).alias("coin_in_mda"),
            amount(or_zero("mdy")).alias("coin_in_mdy"),
        )
        .orderBy("fecha_jornada")
    )


def comps_totals(facts: Facts) -> DataFrame:
    """One row; coin-in counts all players, with or without vouchers."""
    whole = facts.rows["comps"].agg(
        F.count(F.lit(1)).alias("total_cortesias"),
        total("amount").alias("monto"),
        F.count_distinct("client_id").alias("clientes_unicos"),
    )
    coin_in = amount("period_coin_in")
    return with_scalar(whole, facts.coin_in_total("play", "points")).select(
        "total_cortesias",
        amount("monto").alias("monto_total"),
        "clientes_unicos",
        coin_in.alias("total_coin_in"),
        F.when(coin_in > 0, amount(or_zero("monto")) / coin_in * 100.0)
        .otherwise(F.lit(0.0))
        .alias("pct_cortesias_coin_in"),
    )


def daily_comps(facts: Facts) -> DataFrame:
    return (
        facts.rows["comps"]
        .where(F.col("gaming_date").isNotNull())
        .groupBy(F.col("gaming_date").alias("fecha"))
        .agg(amount(total("amount")).alias("monto"))
        .orderBy("fecha")
    )


def daily_play(facts: Facts) -> DataFrame:
    return (
        facts.rows["play"]
        .groupBy(F.col("gaming_date").alias("fecha"))
        .agg(amount(total("coin_in")).alias("monto"))
        .orderBy("fecha")
    )


def comps_with_manager(facts: Facts, area: str = "", jefe: str = "") -> DataFrame:
    """Every voucher with the name and area of the manager who granted it, empty if unknown."""
    rows = authorised_by(facts.rows["comps"], facts.ledgers.managers, area, jefe)
    return left_join(rows, facts.ledgers.managers, ["user_id"]).select(
        *facts.rows["comps"].columns,
        F.coalesce("name", F.lit("")).alias("jefe_nombre"),
        F.coalesce("area", F.lit("")).alias("jefe_area"),
    )

