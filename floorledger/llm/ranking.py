"""Ranked lexical search that scores equal bags of terms once.

Documents are restricted to the terms of the items.  Those that then have the same term counts and the same length
measure ``m`` score alike for every item, so they form a class: grouped by a hash of the vector, and by the vector itself,
which verifies the hash.  Only classes are scored, against a block of items at a time; of each item's best classes the
members with the smallest ids become its documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floorledger.llm.scratch import stored

TOP = 20
# Items that are searched together, in one pass over the texts, and items times terms, which is what a task holds of them.
ITEMS_PER_BLOCK, CELLS_PER_BLOCK = 1024, 1 << 24
CLASSES_PER_BATCH = 4096

# The ranking function in integers.
LENGTH_SHARE, LENGTH_BASE, SATURATION, SCALE = 25, 100, 12, 1_000_000_000
# Fixed value: bytes of a term after A-Z are lowered; beyond ASCII all count.
_TERM = frozenset([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_LOWERED = [code + 32 if 65 <= code <= 90 else code for code in range(256)]
_TERMS_ONLY = bytes(code if code in _TERM else 32 for code in _LOWERED)

_CLASS = ["hash", "m", "terms", "counts"]
_BAG = "doc_id long, n long, terms array<int>, counts array<int>"


def term_list(text: bytes | None) -> list[bytes]:
    """Terms of a whole text in UTF-8: blanks take the place of all else, bytes beyond ASCII are kept as they are."""
    return (text or b"").translate(_TERMS_ONLY).split()


@dataclass(frozen=True)
class Block:
    """Items that are searched together: their numbers, and for each the number of its terms by column."""

    numbers: list[int]
    vocabulary: dict[bytes, int]
    wanted: list[Counter]


def asked_matrix(wanted: list[Counter], terms: int) -> np.ndarray:
    """Row per term, column per item: how often the item asks for the term."""
    asked = np.zeros((terms, len(wanted)), dtype=np.int32)
    for column, own in enumerate(wanted):
        for term, times in own.items():
            asked[term, column] = times
    return asked


def item_blocks(items: DataFrame) -> Iterator[Block]:
    """The items in blocks; items come to the driver one after the other, a block is all it holds."""
    numbers, vocabulary, wanted = [], {}, []
    for row in items.select("number", "text").toLocalIterator():
        terms = Counter(term_list(row.text))
        cells = (len(numbers) + 1) * (len(vocabulary) + len(terms))
        if numbers and (len(numbers) == ITEMS_PER_BLOCK or cells > CELLS_PER_BLOCK):
            yield Block(numbers, vocabulary, wanted)
            numbers, vocabulary, wanted = [], {}, []
        numbers.append(row.number)
        wanted.append(Counter({vocabulary.setdefault(term, len(vocabulary)): n for term, n in terms.items()}))
    if numbers:
        yield Block(numbers, vocabulary, wanted)


def bags(documents: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, counts`` of every document: all its terms, and those of the vocabulary with their numbers."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]
    )

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary
        for part in parts:
            sizes, terms, counts, ends = [], [], [], [0]
            for text in part.column(1):
                found = term_list(text.as_py())
                sizes.append(len(found))
                own = sorted((known[term], times) for term, times in Counter(found).items() if term in known)
                terms += [term for term, _ in own]
                counts += [times for _, times in own]
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32())) for values in (terms, counts)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), *lists], schema=schema)

    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    return texts.mapInArrow(counted, _BAG)


def document_frequencies(bags_: DataFrame, width: int) -> np.ndarray:
    """In how many documents each term of the block is: added up in tasks, a row per task and term."""

    def added(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(width, dtype=np.int64)
        for part in parts:
            found += np.bincount(part.column(0).flatten().to_numpy(zero_copy_only=False), minlength=width)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], ["term", "documents"])

    tasks = bags_.select("terms").mapInArrow(added, "term long, documents long")
    rows = tasks.groupBy("term").agg(F.sum("documents").alias("documents")).toArrow()
    frequencies = np.zeros(width, dtype=np.int64)
    frequencies[rows.column("term").to_numpy()] = rows.column("documents").to_numpy()
    return frequencies


def term_weights(frequencies: np.ndarray, with_terms: int) -> np.ndarray:
    """Fixed rule: thousandths of the logarithm, rounded down."""
    return np.array(
        [math.floor(1000 * math.log((2 * with_terms + 2) / (2 * int(df) + 1))) for df in frequencies], dtype=np.int64
    )


def vectors(bags_: DataFrame, with_terms: int, all_terms: int) -> DataFrame:
    """``doc_id, hash, m, terms, counts`` of the documents that hold a term of the block."""
    m = F.expr(f"{LENGTH_BASE - LENGTH_SHARE} + ({LENGTH_SHARE} * n * {with_terms}) div {max(all_terms, 1)}")
    measured = bags_.where(F.size("terms") > 0).select("doc_id", m.alias("m"), "terms", "counts")
    return measured.withColumn("hash", F.xxhash64("terms", "counts", "m"))


def bag_classes(vectors_: DataFrame) -> DataFrame:
    """``class, hash, m, terms, counts, low`` (smallest id): one row per distinct vector and length measure.

    Rows are grouped by hash, vector and measure at once: the hash deals them out, the rest verifies it.  Copies are put
    together where they are read, so that a class of very many documents arrives as a row per task.
    """
    classes = vectors_.groupBy(*_CLASS).agg(F.min("doc_id").alias("low"))
    return classes.withColumn("class", F.monotonically_increasing_id())


def best_classes(classes: DataFrame, block: Block, weights: np.ndarray, top: int = TOP) -> DataFrame:
    """``item, class, low, score``: the best classes of each item, by score, then smallest id.

    A task keeps the best of each item over all its batches.  A document among the best is in one of these classes, for
    a class is only left out when as many better documents stand in others.
    """
    wanted, width = block.wanted, len(block.numbers)
    numbers = np.array(block.numbers, dtype=np.int64)
    no_id = np.iinfo(np.int64).max

    def scores(part: pa.RecordBatch, asked: np.ndarray) -> np.ndarray:
        """A row per class of the batch, a column per item."""
        terms, counts = part.column("terms"), part.column("counts")
        lengths = np.diff(terms.offsets.to_numpy())
        term, tf = (column.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for column in (terms, counts))
        m = np.repeat(part.column("m").to_numpy(zero_copy_only=False), lengths)
        impact = weights[term] * ((SCALE * tf) // (1000 * tf + SATURATION * m))
        owner = np.repeat(np.arange(len(lengths)), lengths)
        out = np.zeros((len(lengths), width), dtype=np.int64)
        step = max(1, (1 << 22) // width)
        for at in range(0, len(term), step):
            here = slice(at, at + step)
            rows, first = np.unique(owner[here], return_index=True)
            out[rows] += np.add.reduceat(asked[term[here]] * impact[here, None], first, axis=0)
        return out

    def kept(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = asked_matrix(wanted, len(weights))
        best = [np.empty((0, 3), dtype=np.int64) for _ in range(width)]
        for part in parts:
            ids = part.column("class").to_numpy(zero_copy_only=False)
            low = part.column("low").fill_null(no_id).to_numpy(zero_copy_only=False)
            found = scores(part, asked)
            for item in range(width):
                own, held = found[:, item], best[item]
                least = held[-1, 0] if len(held) == top else 1
                near = np.flatnonzero(own >= least)
                if len(near):
                    rows = np.concatenate([held, np.stack([own[near], low[near], ids[near]], axis=1)])
                    best[item] = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[:top]]
        rows = np.concatenate(best)
        items = np.repeat(numbers, [len(of) for of in best])
        columns = [items, rows[:, 2], rows[:, 1], rows[:, 0]]
        yield pa.RecordBatch.from_arrays([pa.array(column) for column in columns], ["item", "class", "low", "score"])

    columns_ = classes.select("class", "m", "terms", "counts", "low")
    tasks = columns_.mapInArrow(kept, "item long, class long, low long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "low", "class")
    return tasks.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).drop("place")


def expanded(vectors_: DataFrame, classes: DataFrame, winners: DataFrame, top: int = TOP) -> DataFrame:
    """``item, doc_id, score``: the documents of the winning classes with the smallest ids.

    Members are looked for by the hashes of the winning classes, of which there are at most ``top`` per item of a block,
    so that they can be broadcast.  No more than ``top`` members of a class can be needed; the others go where they are
    read.  Those that are left are verified by vector and measure.
    """
    chosen = stored(classes.join(F.broadcast(winners.select("class").distinct()), "class").drop("low"))
    near = vectors_.join(F.broadcast(chosen.select("hash").distinct()), "hash")
    first = Window.partitionBy(*_CLASS).orderBy(F.asc_nulls_last("doc_id"))
    few = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= top)
    members = few.join(chosen, _CLASS).select("class", "doc_id")
    return members.join(F.broadcast(winners), "class").select("item", "doc_id", "score")


def ranked(documents: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's best documents with a score above 0, ties by ascending doc_id.

    A null or empty text has no terms: such a document matches nothing, such an item finds nothing.  Rows without an id
    take part and come last among equal scores; rows that repeat are ranked each on its own, and so are items.
    """
    spark = documents.sparkSession
    asked = items.select("item_id", F.col("text").cast("string").cast("binary").alias("text"))
    asked = stored(asked.withColumn("number", F.monotonically_increasing_id()))
    found = None
    for block in item_blocks(asked):
        own = stored(bags(documents, block.vocabulary))
        totals = own.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.sum("n").alias("terms")).first()
        with_terms, all_terms = totals.documents, totals.terms or 0
        weights = term_weights(document_frequencies(own, len(block.vocabulary)), with_terms)
        measured = vectors(own, with_terms, all_terms)
        classes = stored(bag_classes(measured))
        winners = stored(best_classes(classes, block, weights, top), CLASSES_PER_BATCH)
        rows = expanded(measured, classes, winners, top)
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = spark.createDataFrame([], "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    placed = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    named = asked.select("item_id", F.col("number").alias("item"))
    return placed.join(named, "item").select("item_id", "rank", "doc_id", "score")
