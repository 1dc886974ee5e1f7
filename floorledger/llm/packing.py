"""Best-fit packing of tokenised documents into sequences, after Martello-Toth dominance reduction.

Only lengths matter for packing, and a piece has between 1 and ``capacity`` tokens.  So the packing is worked out
on the histogram of lengths, which has at most ``capacity`` rows at any size of input, and comes back as runs:
"the pieces of length L with ranks r.. go to the bins b.., n to a bin, from offset o".  Tokenising, ranking the
pieces within their length and looking the ranks up in the runs are distributed.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floorledger.llm.scratch import stored

CAPACITY = 2048
# Fixed value: the id that ends each document.
END_ID = 0
# Entries in a task's memory of encoded words; it starts anew beyond them.
WORDS_KEPT = 500_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


# --- tokens -----------------------------------------------------------------------------------------------------


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself if printable, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in printable]
    return {byte: chr(byte) for byte in printable} | {byte: chr(256 + n) for n, byte in enumerate(others)}


@lru_cache(maxsize=1)
def loaded_tokenizer(path: str):
    """The tokenizer of a file, read once per worker rather than once per task."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def packed_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds(dict):
    """Encoded ids (little-endian unsigned 32-bit) of each blank-delimited word, kept from its first use on.

    The vocabulary never joins characters over a blank, so a text's ids are those of its words in turn.  A word of
    letters, with or without one final stop or comma, goes straight to the tokenizer's model; any other is encoded in
    the ordinary way.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = loaded_tokenizer(path)
        self.letters = byte_letters()

    def encode(self, text: str) -> bytes:
        return packed_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, word: str) -> bytes:
        if len(self) > WORDS_KEPT:
            self.clear()
        if word[-1:] in (".", ",") and word[:-1].isalpha():
            ids = self[word[:-1]] + self[word[-1]]
        elif word.isalpha():
            spelled = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
            ids = packed_ids([token.id for token in self.tokenizer.model.tokenize(spelled)])
        else:
            ids = self.encode(word)
        self[word] = ids
        return ids

    def of_text(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.encode(text)  # case folding and composition are the tokenizer's own there
        if "<|" in text:
            return self.encode(text)  # special tokens are found before case is folded
        return b"".join(map(self.__getitem__, text.lower().replace("\n", " ").split(" ")))


def token_pieces(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each row: whole documents up to ``capacity`` ids, longer ones cut.

    Null text counts as empty, so every row has at least its end id.  Null ids, repeated ids and repeated rows each
    give their own pieces.
    """

    def pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = WordIds(vocabulary), np.array([END_ID], dtype="<u4").tobytes()
        for part in parts:
            rows: list[tuple] = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                ids = words.of_text(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own)))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [()] * 5
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(column), kind) for column, kind in zip(columns, types, strict=True)], names
            )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, PIECES)


# --- packing of a histogram -------------------------------------------------------------------------------------


@dataclass
class Runs:
    """Where the pieces of each length go; ``used`` counts the pieces of a length that have a place."""

    rows: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    used: dict[int, int] = field(default_factory=dict)
    bins: int = 0

    def place(self, length: int, count: int, each: int, first_bin: int, offset: int) -> None:
        """``count`` pieces, ``each`` to a bin (the last bin may get fewer)."""
        rank = self.used.get(length, 0)
        self.rows.append((length, rank, count, each, first_bin, offset))
        self.used[length] = rank + count

    def close(self, lengths: list[int], times: int) -> None:
        """``times`` finished bins, each with these lengths."""
        offset = 0
        for length in lengths:
            self.place(length, times, 1, self.bins, offset)
            offset += length
        self.bins += times


def _smallest(counts: dict[int, int], sizes: list[int], without: int, n: int) -> list[int]:
    found: list[int] = []
    for size in sizes:
        found += [size] * min(n - len(found), counts[size] - (size == without))
        if len(found) == n:
            break
    return found


def _largest(counts: dict[int, int], sizes: list[int], room: int, taken: tuple[int, ...]) -> int:
    """The largest size up to ``room`` with a piece left beside the taken ones, else 0."""
    for at in range(bisect_right(sizes, room) - 1, -1, -1):
        if counts[sizes[at]] > taken.count(sizes[at]):
            return sizes[at]
    return 0


def _best_pairs(counts: dict[int, int], sizes: list[int], room: int, without: int) -> tuple[int, int]:
    """Over all pairs that fit together: the largest sum, and the largest smaller half."""
    best_sum = best_small = 0
    high = bisect_right(sizes, room) - 1
    for low, small in enumerate(sizes[: high + 1]):
        while high >= low and small + sizes[high] > room:
            high -= 1
        if high < low:
            break
        taken = (without, small)
        big = _largest(counts, sizes, room - small, taken)
        if counts[small] > (small == without) and big >= small:
            best_sum, best_small = max(best_sum, small + big), max(best_small, small)
    return best_sum, best_small


def dominating_set(counts: dict[int, int], sizes: list[int], first: int, capacity: int) -> list[int] | None:
    """A set of up to three lengths around ``first`` that dominates every other set with it, if one is proven.

    One set dominates another if the other can be split into parts that fit, one each, into its members' places;
    then some optimal packing holds the first set as a bin.
    """
    room = capacity - first
    mate = _largest(counts, sizes, room, (first,))
    if not mate:
        return [first]  # nothing fits beside it
    if mate == room:
        return [first, mate]  # a full bin, and any set beside ``first`` fits into its mate's place
    few = _smallest(counts, sizes, first, 3)
    if len(few) < 2 or few[0] + few[1] > room:
        return [first, mate]  # only single pieces fit, and this is the largest
    if len(few) > 2 and sum(few) <= room:
        return None  # sets of four are possible; not looked into
    best_sum, best_small = _best_pairs(counts, sizes, room, first)
    if best_sum <= mate:
        return [first, mate]  # every pair fits into the mate's place
    third = _largest(counts, sizes, room - mate, (first, mate))
    if third and best_small <= third:
        return [first, mate, third]  # member by member at least as large as any single piece or pair
    return None


def reduce_instance(counts: dict[int, int], runs: Runs, capacity: int) -> None:
    """Fix dominating sets, largest pieces first, until none is left; takes the fixed pieces out of ``counts``.

    What dominates once still does when only copies of its own members are taken away, so all copies go at once.
    """
    fixed = True
    while fixed:
        fixed = False
        for first in sorted(counts, reverse=True):
            while first in counts:
                sizes = sorted(counts)
                members = dominating_set(counts, sizes, first, capacity)
                if members is None:
                    break
                times = min(counts[size] // members.count(size) for size in members)
                runs.close(members, times)
                for size in members:
                    counts[size] -= times
                for size in set(members):
                    if not counts[size]:
                        del counts[size]
                fixed = True


def best_fit(counts: dict[int, int], runs: Runs, capacity: int) -> None:
    """Best fit, longest first: a piece goes to the fullest open bin that can hold it, else to a new one."""
    open_bins: dict[int, list[tuple[int, int]]] = {}  # room left: ranges (first bin, bins)
    rooms: list[int] = []

    def leave(room: int, first_bin: int, bins: int) -> None:
        if room and bins:
            if room not in open_bins:
                insort(rooms, room)
            open_bins.setdefault(room, []).append((first_bin, bins))

    def fill(length: int, count: int, room: int, first_bin: int, bins: int) -> int:
        """Puts up to ``count`` pieces into bins with equal room; gives back how many are left."""
        each = room // length
        full, rest = divmod(min(count, each * bins), each)
        if full:
            runs.place(length, full * each, each, first_bin, capacity - room)
        if rest:
            runs.place(length, rest, rest, first_bin + full, capacity - room)
        leave(room - each * length, first_bin, full)
        if rest:
            leave(room - rest * length, first_bin + full, 1)
        untouched = full + bool(rest)
        leave(room, first_bin + untouched, bins - untouched)
        return count - full * each - rest

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_right(rooms, length - 1)
            if at == len(rooms):
                bins = -(-left // (capacity // length))
                left, runs.bins = fill(length, left, capacity, runs.bins, bins), runs.bins + bins
                continue
            room = rooms[at]
            first_bin, bins = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[at]
            left = fill(length, left, room, first_bin, bins)


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> Runs:
    runs, counts = Runs(), {length: count for length, count in histogram.items() if count}
    reduce_instance(counts, runs, capacity)
    best_fit(counts, runs, capacity)
    return runs


# --- assignment -------------------------------------------------------------------------------------------------


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds ``rank``: 0, 1, ... within each length.

    Ranks are counted inside buckets of pieces dealt by hash, then shifted by what earlier buckets hold, so that a
    length that a third of the pieces share is spread like any other.
    """
    parts = max(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int")
    dealt = pieces.withColumn("bucket", bucket)
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        dealt.groupBy("length", "bucket")
        .count()
        .select("length", "bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("shift"))
    )
    inside = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")
    counted = dealt.withColumn("rank", F.row_number().over(inside) - 1)
    return counted.join(shifts, ["bucket", "length"]).select(
        *pieces.columns, (F.col("rank") + F.col("shift")).alias("rank")
    )


def assigned(pieces: DataFrame, runs: Runs) -> DataFrame:
    """Looks each ranked piece up in the runs, whose number is bounded by the capacity, not by the input."""
    table = np.array(sorted(runs.rows), dtype=np.int64).reshape(-1, 6)
    wide = int(table[:, 1].max()) + 1 if len(table) else 1

    def places(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] * wide + table[:, 1]
        for part in parts:
            length, rank = (part.column(name).to_numpy(zero_copy_only=False) for name in ("length", "rank"))
            run = table[np.searchsorted(keys, length * wide + np.minimum(rank, wide - 1), side="right") - 1]
            place = rank - run[:, 1]
            sequence, offset = run[:, 4] + place // run[:, 3], run[:, 5] + place % run[:, 3] * length
            columns = [part.column(n) for n in range(5)] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[:5], "sequence_id", "offset"])

    return ranked(pieces).mapInArrow(places, PACKED)


def pack_documents(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and its place there; an empty table gives no rows."""
    pieces = stored(token_pieces(documents, vocabulary, capacity))
    histogram = {row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()}
    return assigned(pieces, pack_histogram(histogram, capacity))
