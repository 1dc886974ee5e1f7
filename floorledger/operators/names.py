"""Names for vouchers that came without one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorledger.functions.text import is_blank
from floorledger.operators.activity import client_activity
from floorledger.operators.lookup import lookup_join

# Placeholders of the reports.
NO_PLAY_NAME = "(Sin registro en SRW)"
NO_NAME = "(Sin nombre)"


def filled_name(name: Column, play_name: Column) -> Column:
    """The voucher's own name, else the name in slot play, else the placeholder."""
    fallback = F.when(is_blank(play_name), F.lit(NO_PLAY_NAME)).otherwise(play_name)
    return F.when(is_blank(name), fallback).otherwise(name)


def backfill_names(comps: DataFrame, play: DataFrame) -> DataFrame:
    """All vouchers with a name; only those that lack one are looked up."""
    blank = is_blank(F.col("client_name"))
    names = client_activity({"play": play}, "slot_name")
    found = lookup_join(comps.where(blank), names, ["client_id"])
    named = found.withColumn("client_name", filled_name(F.col("client_name"), F.col("slot_name")))
    return comps.where(~blank).unionByName(named.drop("slot_name"))
