"""Benchmark passages in training documents, found through a positional inverted index.

The index holds, for every word that occurs in the benchmark, its places in all documents; an end mark per document
tells its number of words.  A window of benchmark words is looked for from its rarest word: the places of its two
rarest words, each moved back by the word's offset in the window, are intersected to candidate starts, and the lists
of all its words confirm a start.  With a slack, words may stand that many places off: a proximity match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from floorledger.llm.joins import text_key
from floorledger.llm.scratch import stored
from floorledger.llm.words import words

WINDOW_WORDS = 10
# Places that a word may be off in a proximity match.
NEAR_SLACK = 1
# Stands for a null doc_id inside the index.
NO_ID = -(2**63)
# The end mark: no word is empty.
END_MARK, END_TERM = "", -1

_DOC = ["doc", "key"]


@dataclass
class PositionalIndex:
    """postings: doc, key, pos, term (key tells texts of one doc_id apart).  plan: window, size, offset, term, order
    (0 for a window's rarest word).  items: window, item."""

    postings: DataFrame
    plan: DataFrame
    items: DataFrame


def _windows(benchmark: DataFrame, words_each: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows by number, and the items that hold them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - words_each + 1, F.lit(1)))
    terms = items.where((F.size("words") > 0) & F.col("item").isNotNull()).select(
        "item", F.explode(F.transform(starts, lambda at: F.slice("words", at, words_each))).alias("terms")
    )
    distinct = stored(terms.select("terms").distinct().withColumn("window", F.monotonically_increasing_id()))
    return distinct, stored(terms.join(distinct, "terms").select("window", "item").distinct())


def positional_index(documents: DataFrame, benchmark: DataFrame, words_each: int = WINDOW_WORDS) -> PositionalIndex:
    windows, items = _windows(benchmark, words_each)
    placed = windows.select("window", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "word"))
    named = placed.select("word").distinct().withColumn("term", F.monotonically_increasing_id())
    mark = named.sparkSession.range(1).select(F.lit(END_MARK).alias("word"), F.lit(END_TERM).cast("long").alias("term"))
    vocabulary = stored(named.unionByName(mark))

    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    marked = F.concat(words(text), F.array(F.lit(END_MARK)))
    places = documents.select(
        F.coalesce(doc_id, F.lit(NO_ID)).alias("doc"), text_key(text).alias("key"), marked.alias("words")
    ).select("doc", "key", F.posexplode("words").alias("pos", "word"))
    # The vocabulary is joined by its size on disk: broadcast where that is small, else shuffled.
    postings = stored(places.join(vocabulary, "word").select("doc", "key", "pos", "term"))

    counts = postings.groupBy("term").count()
    known = vocabulary.join(counts, "term", "left").select("word", "term", F.coalesce("count", F.lit(0)).alias("places"))
    rarest = Window.partitionBy("window").orderBy("places", "offset")
    plan = placed.join(known, "word").withColumn("order", F.row_number().over(rarest) - 1)
    return PositionalIndex(postings, stored(plan.select("window", "size", "offset", "term", "order")), items)


def matches(index: PositionalIndex, slack: int = 0) -> DataFrame:
    """``doc, key, window, size, start, exact``: phrases whose words stand up to ``slack`` places off where the rarest
    word puts them, and whether none is off."""
    off = F.sequence(F.lit(-slack), F.lit(slack))
    anchors = index.plan.where("order < 2").select(
        "window", "size", "term", "order",
        F.explode(F.when(F.col("order") == 0, F.array(F.col("offset"))).otherwise(
            F.transform(off, lambda d: F.col("offset") + d)
        )).alias("offset"),
    )
    lists = index.postings.join(anchors, "term").select(
        *_DOC, "window", "size", (F.col("pos") - F.col("offset")).alias("start"), (F.col("order") + 1).alias("which")
    )
    needed = F.when(F.col("size") > 1, 3).otherwise(1)
    # With a slack, a phrase at the head of a text may be put to start before it.
    candidates = stored(
        lists.where(F.col("start") >= -slack)
        .groupBy(*_DOC, "window", "size", "start")
        .agg(F.bit_or("which").alias("found"))
        .where(F.col("found") == needed)
        .drop("found")
    )
    # What each candidate expects where, against the lists of the candidates' documents.
    expected = candidates.join(index.plan.select("window", "offset", "term"), "window").select(
        *_DOC, "window", "size", "start", "offset", "term", F.explode(off).alias("off"),
    )
    expected = expected.withColumn("pos", F.col("start") + F.col("offset") + F.col("off"))
    touched = stored(candidates.select(*_DOC).distinct())
    nearby = index.postings.join(touched, _DOC, "left_semi")
    present = expected.join(nearby, [*_DOC, "pos", "term"], "left_semi")
    # Words found, as bits by their place in the phrase: near by, and just there.
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("offset").cast("int"))
    counted = present.groupBy(*_DOC, "window", "size", "start").agg(
        F.bit_or(bit).alias("near"), F.bit_or(F.when(F.col("off") == 0, bit)).alias("there")
    )
    return counted.where(F.bit_count("near") == F.col("size")).select(
        *_DOC, "window", "size", "start",
        F.coalesce(F.bit_count("there") == F.col("size"), F.lit(False)).alias("exact"),
    )


def contamination(
    documents: DataFrame, benchmark: DataFrame, words_each: int = WINDOW_WORDS, slack: int = NEAR_SLACK
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, key`` for every row.

    The first ones are about exact phrases; ``n_near`` counts proximity matches besides: places where a window's words
    stand up to ``slack`` off.  A null text has no words.  An item without words or without an id takes no part; items
    that repeat an id are one.  An item of fewer words than a window is one window; a window has 62 words at most.
    Repeated rows each get the same result; ``key`` tells texts of one doc_id apart.
    """
    if not 0 < words_each < 63:
        raise ValueError(f"{words_each} words in a window")
    index = positional_index(documents, benchmark, words_each)
    near = stored(matches(index, slack))
    found = near.where("exact")
    hit = (
        found.select(*_DOC, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("pos"))
        .distinct()
        .groupBy(*_DOC)
        .agg(F.count(F.lit(1)).alias("n_hit"))
    )
    named = found.select(*_DOC, "window").distinct().join(index.items, "window").select(*_DOC, "item").distinct()
    listed = named.groupBy(*_DOC).agg(
        F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items")
    )
    off = near.groupBy(*_DOC).agg(F.count(F.when(~F.col("exact"), 1)).alias("n_near"))
    documents_ = index.postings.where(F.col("term") == END_TERM)
    rows = documents_.join(off.join(hit.join(listed, _DOC), _DOC, "left"), _DOC, "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"),
        F.col("pos").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        "key",
    )
