"""General summary: totals, and slot players who received a voucher or a prize."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorledger.functions.money import amount, joined, or_zero, pct_half_even, pct_half_up, ratio_pct, total
from floorledger.operators.activity import coin_in_of, contributions
from floorledger.operators.facts import Facts, with_scalar
from floorledger.operators.ordering import ordered


def summary_kpis(facts: Facts) -> DataFrame:
    """One row of period totals."""
    play = contributions(
        facts.rows, "play", "client_id", "total_games", "promo_in_whole", "promo_in_millionths"
    ).agg(
        or_zero(joined(F.sum("promo_in_whole"), F.sum("promo_in_millionths"))).alias("promo"),
        or_zero(F.sum("total_games")).alias("total_games"),
        F.count_distinct("client_id").alias("jugadores_srw"),
    )
    comps = facts.rows["comps"].agg(
        or_zero(total("amount")).alias("comps"), F.count_distinct("client_id").alias("clientes_cortesias")
    )
    prizes = contributions(facts.rows, "prizes", "client_id", "prize_amount_whole", "prize_amount_millionths").agg(
        or_zero(joined(F.sum("prize_amount_whole"), F.sum("prize_amount_millionths"))).alias("prizes"),
        F.count_distinct("client_id").alias("clientes_premios"),
    )
    one = reduce(with_scalar, [facts.coin_in_total("play", "points"), play, comps, prizes])
    given = amount("comps") + amount("prizes")
    return one.select(
        amount("period_coin_in").alias("total_coin_in"),
        amount("promo").alias("total_promo_in"),
        "total_games",
        "jugadores_srw",
        amount("comps").alias("total_cortesias"),
        "clientes_cortesias",
        amount("prizes").alias("total_premios"),
        "clientes_premios",
        ratio_pct(given, amount("period_coin_in")).alias("pct_total"),
    )


def _players(facts: Facts) -> DataFrame:
    """Slot players of the period with a voucher or a prize."""
    players = facts.clients(
        "slot_rows", "slot_name", "player_level", "coin_in", "promo_in", "total_games", "slot_days",
        "table_coin", "prize_rows", "prize_amount",
    ).where(F.col("slot_rows") > 0)
    joined = players.join(facts.vouchers("client_id"), "client_id", "left")
    return joined.where((or_zero("comp_rows") > 0) | (F.col("prize_rows") > 0))


def summary_players(facts: Facts) -> DataFrame:
    """``pct_total_coin_in`` is the player's part of all coin-in of the period."""
    rows = with_scalar(_players(facts), facts.coin_in_total("play", "points"))
    coin_in = amount(coin_in_of(rows))
    shown = rows.select(
        F.col("client_id").alias("player_id"),
        F.col("slot_name").alias("full_name"),
        "player_level",
        coin_in.alias("total_coin_in"),
        amount("promo_in").alias("total_promo_in"),
        "total_games",
        F.col("slot_days").alias("dias_jugados"),
        or_zero("comp_rows").alias("total_cortesias"),
        amount(or_zero("comp_amount")).alias("monto_cortesias"),
        F.col("prize_rows").alias("total_premios"),
        amount(or_zero("prize_amount")).alias("monto_premios"),
        pct_half_even(coin_in, amount("period_coin_in"), 3).alias("pct_total_coin_in"),
    )
    return ordered(shown, "player_id", F.desc("total_coin_in"), "player_id")


def export_summary(facts: Facts) -> DataFrame:
    """``Pct_Total_CoinIn`` is vouchers and prizes against the player's own coin-in."""
    rows = _players(facts)
    coin_in = amount(coin_in_of(rows))
    comps, prizes = amount(or_zero("comp_amount")), amount(or_zero("prize_amount"))
    return rows.select(
        F.col("client_id").alias("ID"),
        F.col("slot_name").alias("Nombre"),
        F.col("player_level").alias("Nivel"),
        coin_in.alias("Coin_In"),
        amount("promo_in").alias("Promo_In"),
        F.col("total_games").alias("Juegos"),
        F.col("slot_days").alias("Dias"),
        or_zero("comp_rows").alias("Cortesias"),
        comps.alias("Monto_Cortesias"),
        F.col("prize_rows").alias("Premios"),
        prizes.alias("Monto_Premios"),
        pct_half_up(comps + prizes, coin_in, 4).alias("Pct_Total_CoinIn"),
    )
