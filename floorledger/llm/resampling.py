"""Documents drawn so that they resemble a target: importance weights, Gumbel noise, and the k-th key by quickselect.

Features are words and pairs of words, hashed to a fixed number of buckets.  A bucket's gain is the logarithm of how much
more common it is in the target than in the corpus; the gains are one array, from which tasks score whole texts.  The draw
keeps the k highest scores: random pivots split the keys that are still in question, exact counts say between which two
of them the k-th lies, and a few rounds leave it alone.  Only the winners are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorledger.llm.scratch import stored

BUCKETS, SEED = 10_000, 7
# Share of the documents drawn, in hundredths, and the words a document needs to take part.
PERCENT, LEAST_WORDS = 25, 20
# Keys looked at in a round; when no more are in question, the k-th is among them.
PIVOTS = 32
# Winners that one task sorts.
WINNERS_PER_TASK = 1 << 20

# Bytes of a word after A-Z are lowered; all beyond ASCII count.
_WORD = frozenset([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_KEY = ["lacking", "id", "row"]
_SPACE = b" "


def _utf8() -> Column:
    return F.col("text").cast("string").cast("binary")


def _words_only() -> bytes:
    lowered = (code + 32 if 65 <= code <= 90 else code for code in range(256))
    return bytes(code if code in _WORD else 32 for code in lowered)


def feature_buckets(text: bytes | None, words_only: bytes) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every feature: the checksum of a pair goes on from that of its first word."""
    found = (text or b"").translate(words_only).split()
    if not found:
        return 0, np.empty(0, dtype=np.int64)
    single = list(map(zlib.crc32, found))
    second = map(_SPACE.__add__, found[1:])
    pairs = map(zlib.crc32, second, single)
    sums = np.empty(2 * len(found) - 1, dtype=np.int64)
    sums[: len(found)] = single
    sums[len(found) :] = np.fromiter(pairs, dtype=np.int64, count=len(found) - 1)
    return len(found), sums % BUCKETS


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features per bucket over all texts; a task gives a row per bucket that it saw."""
    words_only = _words_only()

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for part in parts:
            for text in part.column(0):
                buckets = feature_buckets(text.as_py(), words_only)[1]
                counts += np.bincount(buckets, minlength=BUCKETS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "features"])

    tasks = texts.select(_utf8()).mapInArrow(counted, "bucket long, features long")
    rows = stored(tasks).groupBy("bucket").agg(F.sum("features").alias("features")).toArrow()
    counts = np.zeros(BUCKETS, dtype=np.int64)
    counts[rows.column("bucket").to_numpy()] = rows.column("features").to_numpy()
    return counts


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Fixed rule: thousandths of the logarithm of the smoothed ratio, rounded down."""
    whole, wanted = int(corpus.sum()), int(target.sum())
    ratio = lambda s, t: ((t + 1) * (whole + BUCKETS)) / ((s + 1) * (wanted + BUCKETS))
    return np.array([math.floor(1000 * math.log(ratio(int(s), int(t)))) for s, t in zip(corpus, target)], dtype=np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """Fixed rule: thousandths of Gumbel noise from the id; a null id is an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    number = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((number + 0.5) / 4294967296.0)))


def scored(documents: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every document."""
    words_only = _words_only()

    def weighed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for text in part.column(1):
                n_words, buckets = feature_buckets(text.as_py(), words_only)
                rows.append((n_words, len(buckets), int(gains[buckets].sum()) // len(buckets) if len(buckets) else 0))
            columns = [pa.array(column, pa.int64()) for column in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_words", "n_features", "weight"])

    texts = documents.select(F.col("doc_id").cast("long"), _utf8())
    rows = texts.mapInArrow(weighed, "doc_id long, n_words long, n_features long, weight long")
    return rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


# --- the k-th key -------------------------------------------------------------------------------------------------

Key = tuple[int, int, int]


def _before(key: Key, equal: bool = False) -> Column:
    """Whether a row's key comes before the given one (or is it)."""
    lacking, id_, row = (F.col(name) for name in _KEY)
    last = row <= key[2] if equal else row < key[2]
    return (lacking < key[0]) | ((lacking == key[0]) & ((id_ < key[1]) | ((id_ == key[1]) & last)))


def kth_key(keys: DataFrame, k: int, seed: int = SEED) -> Key:
    """The k-th smallest key of a stored table of different keys, k from 1 to their number.

    Each round draws pivots from the keys between two bounds, and counts how many keys lie below each: the pivots and
    their counts are all that comes to the driver.  The bounds close in by the number of pivots a round.
    """
    low, high, below, turn = None, None, 0, 0
    while True:
        inside = keys
        if low is not None:
            # The first column alone reaches the scan.
            inside = inside.where((F.col("lacking") >= low[0]) & ~_before(low, equal=True))
        if high is not None:
            inside = inside.where((F.col("lacking") <= high[0]) & _before(high))
        order = F.xxhash64(F.lit(seed + turn).cast("long"), *_KEY)
        drawn = inside.select(*_KEY, order.alias("order")).orderBy("order", *_KEY).limit(PIVOTS)
        pivots = sorted(tuple(row)[:3] for row in drawn.collect())
        # Three-way: a key is in the part of how many pivots come before it, or is the pivot itself.
        passed = reduce(lambda a, b: a + b, [(~_before(pivot)).cast("int") for pivot in pivots])
        parts = dict(inside.groupBy(passed.alias("part")).count().collect())
        place = k - below
        if sum(parts.values()) <= len(pivots):
            return pivots[place - 1]
        for part in range(len(pivots) + 1):
            here = parts.get(part, 0)
            if part and place == 1:  # a part begins with its own pivot
                return pivots[part - 1]
            if place <= here:
                break
            place -= here
        below = k - place + bool(part)  # the pivot that begins the part is passed too
        low, high = (pivots[part - 1] if part else low), (pivots[part] if part < len(pivots) else high)
        turn += 1


def ranks(winners: DataFrame, count: int) -> DataFrame:
    """Adds ``rank`` 1, 2, ... in the order of the keys: tasks sort ranges of keys, a place is the range's offset and the
    row's number in it."""
    tasks = max(1, -(-count // WINNERS_PER_TASK))
    sorted_ = winners.repartitionByRange(tasks, *_KEY).sortWithinPartitions(*_KEY)
    placed = stored(sorted_.withColumn("place", F.monotonically_increasing_id()))
    task, number = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    counts = sorted(tuple(row) for row in placed.groupBy(task.alias("task")).count().collect())  # one row per million
    before = accumulate((n for _, n in counts), initial=0)
    offsets = winners.sparkSession.createDataFrame([(at, offset) for (at, _), offset in zip(counts, before)], "task int, offset long")
    return (
        placed.withColumn("task", task.cast("int"))
        .join(F.broadcast(offsets), "task")
        .withColumn("rank", F.col("offset") + number + 1)
        .drop("task", "offset", "place")
    )


def resampled(documents: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every row; rank is null where a document is not drawn.

    A null or empty text has no words: weight 0, and too short to be drawn.  Rows that repeat are drawn each on its own;
    ties go to the smaller id, a null one last, then to the row that was read first.
    """
    gains = bucket_gains(bucket_counts(documents), bucket_counts(target))
    numbered = scored(documents, gains, seed).withColumn("row", F.monotonically_increasing_id())
    keyed = numbered.withColumn("lacking", -F.col("score")).withColumn("id", F.coalesce("doc_id", F.lit(2**63 - 1)))
    rows = stored(keyed)
    able = F.col("n_words") >= LEAST_WORDS
    drawn = rows.where(able).count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not drawn:
        return rows.select(*columns, none)
    last = kth_key(rows.where(able).select(*_KEY), drawn, seed)
    won = able & _before(last, equal=True)
    winners = ranks(rows.where(won).select(*columns, *_KEY), drawn)
    return winners.select(*columns, "rank").unionByName(rows.where(~won).select(*columns, none))
