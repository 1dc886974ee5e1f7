"""Pipeline over the documents: each stage takes what its predecessor kept, as Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorledger.llm.decontamination import contamination
from floorledger.llm.joins import free_name, one_of_each, without_listed
from floorledger.llm.neardup import near_duplicates
from floorledger.llm.packing import pack_documents
from floorledger.llm.quality import score_quality
from floorledger.llm.queries import vocabulary
from floorledger.llm.scratch import stored, temporary
from floorledger.llm.secrets import redacted
from floorledger.llm.tables import corpus

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _names(rows: DataFrame) -> DataFrame:
    """The documents that rows are about, once each, written first so that Spark knows their size when it joins them."""
    return stored(rows.select("doc_id", "key").distinct())


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    As in all stages, a decision is about an id and its text: rows without an id are judged by their text, of two texts
    under one id each for itself, and rows that repeat share their fate.  A null text counts as an empty one.  An empty table
    stays empty; other columns may have any names.
    """
    scores = score_quality(docs, corpus(spark, sf_dir, "labels"))
    return without_listed(docs, _names(scores.where("predicted = 0")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    Texts under one id are one group, of which the one with the smallest hash stays, and of rows that repeat one stays.
    Rows without an id and texts without words are in no group: they all stay.
    """
    found = stored(near_duplicates(docs))
    grouped = found.where("doc_id is not null and n_shingles > 0")
    chosen = grouped.where("kept").groupBy(F.col("doc_id").alias("id")).agg(F.min("key").alias("first"))
    others = grouped.where("kept").join(chosen, F.col("doc_id") == F.col("id")).where("key <> first")
    left = without_listed(docs, _names(grouped.where("not kept").select("doc_id", "key").unionByName(others.select("doc_id", "key"))))
    repeats = _names(grouped.groupBy("doc_id", "key").count().where("count > 1"))
    return left if repeats.isEmpty() else one_of_each(left, repeats)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; rows without an id and repeated rows as in the first stage."""
    found = contamination(docs, corpus(spark, sf_dir, "benchmark"), slack=0)  # phrases only: near ones decide nothing
    return without_listed(docs, _names(found.where("contaminated")))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars follows the text where it changes.

    Every row stays, with or without an id, and so do null and empty texts.
    """
    count = free_name(docs.columns, "redactions")
    clean = redacted(docs, count=count)
    n_chars = F.when(F.col(f"`{count}`") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", n_chars.cast("long")).drop(count)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the documents' tokens; null and empty texts are pieces of length 0, an empty table gives no rows."""
    return pack_documents(docs, vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", good_quality),
    ("minhash_near_dedup", one_of_each_group),
    ("benchmark_decontamination", not_in_benchmark),
    ("secret_scans", without_secrets),
    ("best_fit_packing", packed),
]

# Classifier, sketches and packing have no SQL form; a test compares the pipeline with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage has stored on its way is removed once its result is written."""
    docs = corpus(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with temporary(spark):
            docs = stored(stage(spark, docs, sf_dir), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
