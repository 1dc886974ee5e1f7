"""Joining whole rows to a list of documents that operators decide about.

A document is named by its id and a hash of its text, null-safe: rows without an id, or two texts under one id, are told
apart.  Whole texts are not shuffled for a list: where it is too large to broadcast, a filter of fixed size first finds
the rows that can be on it, and only those are joined.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorledger.operators.keyfilter import key_words, possible_rows
from floorledger.operators.lookup import is_broadcast

_SAME = "listed_doc <=> doc and listed_key = key"


def text_key(text: Column) -> Column:
    """Hash of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def free_name(taken: Iterable[str], name: str) -> str:
    """The name, with underscores after it while it is taken."""
    known = {each.lower() for each in taken}
    while name.lower() in known:
        name += "_"
    return name


def _keyed(documents: DataFrame) -> DataFrame:
    """``row, doc, key``: the row travels as one column, so that its columns may have any names."""
    doc_id, key = F.col("doc_id").cast("long").alias("doc"), text_key(F.col("text")).alias("key")
    return documents.select(F.struct("*").alias("row"), doc_id, key)


def _parted(rows: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows that can be on the list, and the others, if it is worth telling them apart."""
    if is_broadcast(listed):
        return rows, None
    words = key_words(listed.select(F.col("doc_id").alias("doc"), "key"), ["doc", "key"])
    possible = possible_rows(rows, ["doc", "key"], words)
    return possible, possible_rows(rows, ["doc", "key"], words, other=True)


def without_listed(documents: DataFrame, listed: DataFrame) -> DataFrame:
    """The rows that a stored list (doc_id, key) does not name."""
    possible, others = _parted(_keyed(documents), listed)
    names = listed.select(F.col("doc_id").alias("listed_doc"), F.col("key").alias("listed_key"), F.lit(True).alias("on_list"))
    # Not an anti join: Spark would move that below the filter, and shuffle all texts for it.
    left = possible.join(names, F.expr(_SAME), "left").where("on_list is null").select(*possible.columns)
    rows = left if others is None else left.unionByName(others)
    return rows.select("row.*")


def with_listed(documents: DataFrame, listed: DataFrame) -> DataFrame:
    """``row, listed``: every row beside its entry on a stored list (doc_id, key, ...), or null."""
    possible, others = _parted(_keyed(documents), listed)
    entries = listed.select(F.struct("*").alias("listed"), F.col("doc_id").alias("listed_doc"), F.col("key").alias("listed_key"))
    found = possible.join(entries, F.expr(_SAME), "left").select("row", "listed")
    if others is None:
        return found
    return found.unionByName(others.select("row", F.lit(None).cast(found.schema["listed"].dataType).alias("listed")))


def repeated(documents: DataFrame) -> DataFrame:
    """``doc_id, key`` of the documents of which there are several equal rows."""
    names = _keyed(documents).groupBy(F.col("doc").alias("doc_id"), "key").count()
    return names.where("count > 1").drop("count")


def one_of_each(documents: DataFrame, listed: DataFrame) -> DataFrame:
    """All rows, but one only of each document on a stored list (doc_id, key)."""
    found = with_listed(documents, listed)
    several = found.where("listed is not null")
    single = several.withColumn("doc", F.col("listed.doc_id")).withColumn("key", F.col("listed.key"))
    rows = found.where("listed is null").select("row").unionByName(single.dropDuplicates(["doc", "key"]).select("row"))
    return rows.select("row.*")
