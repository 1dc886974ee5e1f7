"""Near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

1. Each text becomes the set of its five-word shingles (64-bit hashes) and a signature by one-permutation hashing:
   each shingle falls into one of the bins, the smallest in a bin stands for it, and an empty bin borrows from a bin
   that a fixed sequence of random probes meets first (optimal densification).
2. Texts with equal sets are one class from here on.
3. Each band of a signature is a bucket.  Inside a bucket only the links to its smallest member, the star's centre,
   are candidates, so a bucket of n classes gives n - 1 pairs.
4. Candidates are confirmed on the full sets; confirmed links are joined into components.
5. A star can miss a link between two members that are both unlike the centre.  So members of buckets that still hold
   more than one component are compared across components wherever they share one of their rarest shingles, which
   every similar pair does, and what sizes and signatures allow is confirmed too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floorledger.llm.graphs import components
from floorledger.llm.joins import text_key
from floorledger.llm.scratch import stored
from floorledger.operators.keyfilter import key_words, possible_rows
from floorledger.operators.lookup import is_broadcast

SHINGLE_WORDS = 5
# Linked when 100 * shared >= 75 * all shingles of the two.
SIMILARITY_PERCENT = 75
# 32 bands of 4 bins: a pair at the threshold shares no bucket once in 200,000, at 0.8 once in 20 million.
BANDS, BAND_BINS = 32, 4
# Equal bins, of all, below which a pair is not fetched for confirmation: 6.5 standard deviations below the threshold.
LEAST_EQUAL_BINS = 64

_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)

_CLASSES = "doc_id long, key long, n_shingles long, set_key string, bands array<long>, bins binary"


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finishing step of a common generator)."""
    values = (values ^ (values >> np.uint64(30))) * _MIX_1
    values = (values ^ (values >> np.uint64(27))) * _MIX_2
    return values ^ (values >> np.uint64(31))


def shingles(text: str | None, words_each: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter text is one shingle, one without words none."""
    words = (text or "").encode().lower().split()  # bytes: A-Z are lowered, words end at ASCII blanks
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(words_each, len(words))
    total = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for at in range(width):
        total = mixed(total + hashes[at : at + len(total)] + _STEP)
    if width < words_each:
        total = mixed(total + np.uint64(width))
    return np.unique(total)


def set_key(hashes: np.ndarray) -> str | None:
    """A 128-bit name of the set, null for an empty one."""
    return xxhash.xxh3_128_hexdigest(hashes.tobytes()) if len(hashes) else None


def probes(bins: int, tries: int = 64) -> np.ndarray:
    """For each bin, the bins it borrows from while empty, in turn."""
    numbers = np.arange(bins * tries, dtype=np.uint64) * _STEP + np.uint64(1)
    return (mixed(mixed(numbers)) % np.uint64(bins)).astype(np.int64).reshape(bins, tries)


def signature(hashes: np.ndarray, borrow: np.ndarray) -> np.ndarray:
    """The densified one-permutation sketch of a non-empty sorted set."""
    bins = len(borrow)
    # The set is sorted, so the first hash of each of the equal ranges is the smallest of its bin.
    place = (hashes // np.uint64(-(-(2**64) // bins))).astype(np.int64)
    own, first = np.unique(place, return_index=True)
    sketch, full = np.zeros(bins, dtype=np.uint64), np.zeros(bins, dtype=bool)
    sketch[own], full[own] = hashes[first], True
    if len(own) < bins:
        empty = np.flatnonzero(~full)
        hits = full[borrow[empty]]
        # The nearest full bin stands in when no probe hits, which takes a set of very few shingles.
        nearest = own[np.searchsorted(own, empty) % len(own)]
        found = np.where(hits.any(axis=1), borrow[empty, hits.argmax(axis=1)], nearest)
        sketch[empty] = sketch[found]
    return sketch


def classes(documents: DataFrame, bands: int = BANDS, band_bins: int = BAND_BINS) -> DataFrame:
    """Per row: a key of its text, the size and key of its shingle set, its band hashes, and one byte of each bin."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borrow = probes(bands * band_bins)
        salt = np.arange(bands, dtype=np.uint64) * _STEP
        for part in parts:
            sizes, keys, hashes, bins = [], [], [], []
            for text in part.column(1):
                own = shingles(text.as_py())
                sizes.append(len(own))
                if not len(own):
                    keys.append(None), hashes.append(None), bins.append(None)
                    continue
                sketch = signature(own, borrow)
                total = salt.copy()
                for column in sketch.reshape(bands, band_bins).T:
                    total = mixed(total + column + _STEP)
                keys.append(set_key(own))
                hashes.append(total.view(np.int64))
                bins.append(sketch.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(2),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.string()),
                    pa.array(hashes, pa.list_(pa.int64())),
                    pa.array(bins, pa.binary()),
                ],
                ["doc_id", "key", "n_shingles", "set_key", "bands", "bins"],
            )

    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long"), text, text_key(text).alias("key")).mapInArrow(rows, _CLASSES)


def _texts(documents: DataFrame, listed: DataFrame) -> DataFrame:
    """``node, text`` of all rows whose id is on a stored list of distinct nodes.

    Where the list is too large to broadcast, a filter of fixed size finds the rows that can be on it, and only their texts
    are shuffled.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string"))
    if not is_broadcast(listed):
        texts = possible_rows(texts, ["node"], key_words(listed, ["node"]))
    # Not a semi join: Spark would move that below the filter, and shuffle all texts for it.
    return texts.join(listed, "node")


def _sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, set_key, hashes`` of all texts of the wanted nodes: their shingle sets, taken from the text again.

    The list of nodes is written first, so that Spark knows its size when it joins the texts.
    """

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [shingles(text.as_py()) for text in part.column(1)]
            keys = pa.array([set_key(own) for own in found], pa.string())
            hashes = pa.array([own.tobytes() for own in found], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), keys, hashes], ["node", "set_key", "hashes"])

    chosen = _texts(documents, stored(wanted.select("node").distinct()))
    found = chosen.mapInArrow(rows, "node long, set_key string, hashes binary")
    return stored(found.dropDuplicates(["node", "set_key"]))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, key_a, b, key_b) whose full sets are similar enough."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keep = []
            for left, right in zip(part.column(2), part.column(3), strict=True):
                one, two = (np.frombuffer(side.as_py(), dtype=np.uint64) for side in (left, right))
                shared = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * shared >= percent * (len(one) + len(two) - shared))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    named = lambda side: {"node": side, "set_key": f"key_{side}", "hashes": f"hashes_{side}"}
    left, right = (
        sets.select(*[F.col(name).alias(new) for name, new in named(side).items()])
        for side in "ab"
    )
    both = pairs.join(right, ["b", "key_b"]).join(left, ["a", "key_a"]).select("a", "b", "hashes_a", "hashes_b")
    return both.mapInArrow(rows, "a long, b long").distinct()


def _equal_bins(left: str, right: str) -> F.Column:
    """On how many bins two signatures agree, by their bytes."""
    return F.expr(
        f"aggregate(sequence(1, length({left})), 0, "
        f"(n, i) -> n + int(substring({left}, i, 1) = substring({right}, i, 1)))"
    )


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int, least_equal_bins: int) -> DataFrame:
    """The pairs that sizes allow and signatures do not rule out, with the names of their sets."""
    one, two = (
        nodes.select(F.col("node").alias(side), *[F.col(n).alias(f"{n}_{side}") for n in ("set_key", "bins", "size")])
        for side in "ab"
    )
    known = pairs.join(one, "a").join(two, "b")
    sizes = 100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")
    return known.where(sizes).where(_equal_bins("bins_a", "bins_b") >= least_equal_bins).select(
        "a", F.col("set_key_a").alias("key_a"), "b", F.col("set_key_b").alias("key_b")
    )


def _occurrences(members: DataFrame) -> DataFrame:
    """``node, component, size, shingle``: a row per shingle of each set."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            own = [np.frombuffer(hashes.as_py(), dtype=np.int64) for hashes in part.column(2)]
            sizes = np.array([len(each) for each in own], dtype=np.int64)
            repeat = np.repeat(np.arange(len(own)), sizes)
            shingle = np.concatenate(own) if own else np.empty(0, dtype=np.int64)
            ends = [part.column(n).take(pa.array(repeat)) for n in (0, 1)]
            columns = [*ends, pa.array(sizes[repeat]), pa.array(shingle)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "component", "size", "shingle"])

    chosen = members.select("node", "component", "hashes")
    return chosen.mapInArrow(rows, "node long, component long, size long, shingle long")


def _crossing(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share one of their rarest shingles; ``members`` has node, component, hashes.

    Two similar sets share at least one of the shingles that come first in both, in any order that holds for all sets,
    and from their first common one on, both must have enough left.  First come shingles that only one component has,
    then the others, rarest first: one that very many texts share is only reached by texts that hold little else.
    """
    rows = _occurrences(members)
    mixed_ = stored(
        rows.groupBy("shingle")
        .agg(F.count(F.lit(1)).alias("often"), F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low < high")
        .drop("high")
    )
    shared = rows.join(mixed_, "shingle")
    own = Window.partitionBy("node")
    place = F.row_number().over(own.orderBy("often", "shingle")) - 1
    placed = shared.withColumn("left", F.count(F.lit(1)).over(own) - place)
    # ``left`` shingles remain from this one on; similar sets share at least percent / 100 of the smaller one.
    placed = stored(placed.where(100 * F.col("left") >= percent * F.col("size")).drop("often"))
    # What decides whether two rows of a shingle can be a pair is the same for all rows with its size and rest: such
    # groups are matched first, and rows meet only where their groups do.
    kind = ["shingle", "size", "left"]
    groups = placed.groupBy(*kind).agg(F.min("component").alias("first"), F.max("component").alias("last"))
    named = lambda frame, side: frame.toDF(*[n if n == "shingle" else f"{n}_{side}" for n in frame.columns])
    enough = (100 + percent) * F.least("left_a", "left_b") >= percent * (F.col("size_a") + F.col("size_b"))
    apart = F.greatest("last_a", "last_b") > F.least("first_a", "first_b")
    matched = named(groups, "a").join(named(groups, "b"), "shingle").where(enough & apart)
    matched = stored(matched.select("shingle", "size_a", "left_a", "size_b", "left_b"))
    rows = placed.select(*kind, "node", "component", "low")
    # Every pair across components has an end outside a shingle's lowest one.
    one = named(rows.where("component <> low").drop("low"), "a").join(matched, ["shingle", "size_a", "left_a"])
    met = one.join(named(rows.drop("low"), "b"), ["shingle", "size_b", "left_b"])
    met = met.where(F.col("component_a") != F.col("component_b"))
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def near_duplicates(
    documents: DataFrame,
    percent: int = SIMILARITY_PERCENT,
    bands: int = BANDS,
    band_bins: int = BAND_BINS,
    least_equal_bins: int = LEAST_EQUAL_BINS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, key`` for every row; ``key`` tells texts of one doc_id apart.

    ``component_id`` is the smallest doc_id reachable over links, ``kept`` whether it is the row's own.  A text
    without words is linked with nothing.  A null doc_id is linked with nothing: component null, kept.  Rows that
    repeat a doc_id keep one row each, and all texts of one doc_id count as linked.  Other columns do not matter.
    """
    rows = stored(classes(documents, bands, band_bins))
    # One node per distinct set, named by its smallest doc_id.
    nodes = stored(
        rows.where("doc_id is not null and set_key is not null")
        .groupBy("set_key")
        .agg(
            F.min("doc_id").alias("node"),
            F.min_by("bands", "doc_id").alias("bands"),
            F.min_by("bins", "doc_id").alias("bins"),
            F.max("n_shingles").alias("size"),
        )
    )
    members = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    buckets = members.groupBy("band", "bucket").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n"))
    shared = stored(members.join(buckets.where("n > 1").drop("n"), ["band", "bucket"]))
    pairs = shared.where("centre <> node").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    pairs = stored(_likely(pairs, nodes, percent, least_equal_bins))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    links = stored(_confirmed(pairs, _sets(documents, ends), percent))
    found = components(links)

    # Buckets that still hold several components: some pairs there have not been looked at.
    placed = shared.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    spread = placed.groupBy("band", "bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    inside = placed.join(spread.where("low < high").select("band", "bucket"), ["band", "bucket"], "left_semi")
    undecided = inside.select("node", "component").distinct()
    undecided = stored(undecided.join(nodes.select("node", "set_key"), "node"))
    if not undecided.isEmpty():
        sets = _sets(documents, undecided)
        crossing = stored(_crossing(undecided.join(sets, ["node", "set_key"]), percent))
        more = stored(_confirmed(_likely(crossing, nodes, percent, least_equal_bins), sets, percent))
        if not more.isEmpty():
            known = found.select(F.col("component").alias("a"), F.col("node").alias("b"))
            found = components(known.unionByName(more))

    of_set = nodes.join(found, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    joined = rows.select("doc_id", "key", "n_shingles", "set_key").join(of_set, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), "key",
    )
