"""The numbered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorledger.llm.archives import archived
from floorledger.llm.decontamination import contamination
from floorledger.llm.kdtree import top_k
from floorledger.llm.language import identify_languages
from floorledger.llm.licenses import licenses
from floorledger.llm.neardup import near_duplicates
from floorledger.llm.packing import pack_documents
from floorledger.llm.quality import score_quality
from floorledger.llm.ranking import ranked
from floorledger.llm.resampling import resampled
from floorledger.llm.secrets import secrets
from floorledger.llm.shuffling import sharded
from floorledger.llm.tables import corpus
from floorledger.llm.urls import url_verdicts


def vocabulary() -> str:
    """The tokenizer file of the packing query."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_license_scans(spark: SparkSession, directory: str) -> DataFrame:
    return licenses(corpus(spark, directory, "documents"))


def op2_best_fit_packing(spark: SparkSession, directory: str) -> DataFrame:
    return pack_documents(corpus(spark, directory, "documents"), vocabulary())


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of the document whose number ends a page's path; bad is low quality or toxic."""
    path = F.regexp_extract(F.col("url"), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    number = F.regexp_extract(path, r"([0-9]{1,18})[^0-9]*$", 1)
    doc_id = F.when(number != "", number).cast("long")
    marks = labels.select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return pages.select("page_id", doc_id.alias("doc_id")).join(marks, "doc_id").select("page_id", "bad")


def op3_url_filters(spark: SparkSession, directory: str) -> DataFrame:
    pages = corpus(spark, directory, "pages")
    judged = url_verdicts(pages, page_labels(pages, corpus(spark, directory, "labels")))
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op4_warc_archives(spark: SparkSession, directory: str) -> DataFrame:
    records = archived(spark, corpus(spark, directory, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_exact_top_k(spark: SparkSession, directory: str) -> DataFrame:
    return top_k(corpus(spark, directory, "embeddings"))


def op6_benchmark_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    return contamination(corpus(spark, directory, "documents"), corpus(spark, directory, "benchmark")).drop("key")


def op7_secret_scans(spark: SparkSession, directory: str) -> DataFrame:
    return secrets(corpus(spark, directory, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return near_duplicates(corpus(spark, directory, "documents")).drop("key")


def op9_language_id(spark: SparkSession, directory: str) -> DataFrame:
    return identify_languages(corpus(spark, directory, "documents"))


def op10_quality_classifier(spark: SparkSession, directory: str) -> DataFrame:
    return score_quality(corpus(spark, directory, "documents"), corpus(spark, directory, "labels")).drop("key")


def op11_sharding(spark: SparkSession, directory: str) -> DataFrame:
    return sharded(corpus(spark, directory, "documents"))


def op12_ranked_lexical_search(spark: SparkSession, directory: str) -> DataFrame:
    return ranked(corpus(spark, directory, "documents"), corpus(spark, directory, "benchmark"))


def op13_importance_resampling(spark: SparkSession, directory: str) -> DataFrame:
    return resampled(corpus(spark, directory, "documents"), corpus(spark, directory, "benchmark"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_license_scans,
        op2_best_fit_packing,
        op3_url_filters,
        op4_warc_archives,
        op5_exact_top_k,
        op6_benchmark_decontamination,
        op7_secret_scans,
        op8_minhash_near_dedup,
        op9_language_id,
        op10_quality_classifier,
        op11_sharding,
        op12_ranked_lexical_search,
        op13_importance_resampling,
    )
}
