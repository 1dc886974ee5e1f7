"""Small ledgers written by hand."""

from __future__ import annotations

from datetime import date

from pyspark.sql import SparkSession

from floorledger.ledgers import SCHEMAS, Ledgers


def day(text: str | None) -> date | None:
    return date.fromisoformat(text) if text else None


def ledgers(spark: SparkSession, play=(), comps=(), prizes=(), points=(), managers=(), tiers=()) -> Ledgers:
    """Short rows: play (day, player, name, level, coin), comps (day, client, name, amount, user),
    prizes (day, client, amount), points (day, client, name, points), managers and tiers in full."""
    rows = {
        "play": [(day(d), p, n, lv, float(c), 1, 0.0) for d, p, n, lv, c in play],
        "comps": [(day(d), c, n, "Bar", "Té", float(a), "QUEMADO", u, "") for d, c, n, a, u in comps],
        "prizes": [(day(d), c, float(a), "Jackpot HP") for d, c, a in prizes],
        "points": [(day(d), c, n, float(p), p * 1000.0) for d, c, n, p in points],
        "managers": list(managers),
        "tiers": list(tiers),
    }
    return Ledgers({name: spark.createDataFrame(rows[name], SCHEMAS[name]) for name in SCHEMAS})


def dicts(frame) -> list[dict]:
    return [row.asDict() for row in frame.collect()]
