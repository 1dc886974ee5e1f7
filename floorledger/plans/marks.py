"""Threshold marks and labels that the report pages put beside the figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorledger.functions.text import level_label, or_text

# Percentages above which a figure is marked, and labels.
VOUCHER_LIMIT_PCT = 1
PRIZE_LIMIT_PCT = 50
TOTAL_LIMIT_PCT = 5
YES, NO = "Sí", "No"
DASH = "—"


def mark_vouchers(df: DataFrame, pct: str = "pct_cortesia_coin_in") -> DataFrame:
    return df.withColumn("alerta", F.coalesce(F.col(pct) > VOUCHER_LIMIT_PCT, F.lit(False)))


def mark_prizes(df: DataFrame, pct: str = "pct_premio_coin_in") -> DataFrame:
    return df.withColumn("alerta", F.coalesce(F.col(pct) > PRIZE_LIMIT_PCT, F.lit(False)))


def mark_total(df: DataFrame, pct: str = "pct_total") -> DataFrame:
    return df.withColumn("alerta", F.coalesce(F.col(pct) > TOTAL_LIMIT_PCT, F.lit(False)))


def mark_balance(df: DataFrame) -> DataFrame:
    return df.withColumn("saldo_disponible", F.col("saldo") >= 0)


def short_levels(df: DataFrame, column: str = "nivel") -> DataFrame:
    return df.withColumn("nivel_corto", level_label(F.col(column)))


def label_audit(df: DataFrame) -> DataFrame:
    """Prize label and a dash for an unknown manager or area."""
    count = F.col("cant_premios")
    won = F.when(count > 0, F.concat(F.lit(f"{YES} ("), count.cast("string"), F.lit(")"))).otherwise(F.lit(NO))
    return df.select(
        "jornada",
        "cliente_id",
        "nombre_cliente",
        "coin_in",
        "cant_cortesias",
        "monto_cortesias",
        won.alias("premio"),
        "monto_premios",
        or_text(F.col("jefe_area"), DASH).alias("area"),
        or_text(F.col("jefe_nombre"), DASH).alias("autorizo"),
    )
