"""A corpus in random order, cut into shards: the two-pass external shuffle.

First pass: every record goes to a bucket by a seeded hash of its number, so buckets are of even size whatever the
records hold, and there are as many as it takes for one to fit a task's memory.  Second pass: each bucket is put in its
first order, shuffled by Fisher and Yates with a generator of its own, and written.  The written buckets, one after the
other, are the random order; a small manifest says where each begins, and shards are even runs of that order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorledger.llm.scratch import stored

SHARDS, SEED = 24, 11
# Bytes of text in a bucket: a task holds a bucket about three times while it shuffles it.
BUCKET_BYTES = 16 << 20
# What a record counts beside its text.
RECORD_BYTES = 8
# Buckets whose offsets one task adds up.
_BLOCK = 4096

LAW = "rows"


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text, none for null, and a fixed part."""
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long") + RECORD_BYTES


def bucket_count(documents: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    whole = documents.agg(F.sum(record_size(F.col("text"))).alias("bytes")).first()["bytes"] or 0
    return max(1, -(-whole // bucket_bytes))


def shuffled_buckets(documents: DataFrame, seed: int, buckets: int) -> DataFrame:
    """``bucket, place, row``: the rows of each bucket in shuffled order, ``row`` a struct of all columns.

    Records are numbered in the order in which they are read, so equal records part as any others do.  A bucket is a
    task of its own, which makes its generator, and so the order, depend on seed and numbers alone.
    """
    numbered = documents.select(F.struct("*").alias("row")).withColumn("number", F.monotonically_increasing_id())
    bucket = F.pmod(F.xxhash64(F.lit(seed).cast("long"), "number"), F.lit(buckets).cast("long")).cast("int")
    dealt = numbered.withColumn("bucket", bucket).repartitionById(buckets, "bucket")
    gathered = dealt.groupBy("bucket").agg(F.collect_list(F.struct("number", "row")).alias("rows"))
    by_number = lambda one, other: F.when(one["number"] < other["number"], -1).otherwise(1)
    ordered = gathered.select("bucket", F.array_sort("rows", by_number).alias("rows"))
    mixed = ordered.select("bucket", F.shuffle("rows", seed).alias("rows"))
    return mixed.select("bucket", F.posexplode("rows").alias("place", "entry")).select("bucket", "place", "entry.row")


def manifest(rows: DataFrame) -> DataFrame:
    """``bucket, first``: how many rows precede each bucket, added up within blocks and then over the few blocks."""
    counted = rows.groupBy("bucket").count().withColumn("block", F.floor(F.col("bucket") / _BLOCK))
    before = lambda window: window.rowsBetween(Window.unboundedPreceding, -1)
    inside = before(Window.partitionBy("block").orderBy("bucket"))
    blocks = counted.groupBy("block").agg(F.sum("count").alias("count"))
    offsets = blocks.select("block", F.coalesce(F.sum("count").over(before(Window.orderBy("block"))), F.lit(0)).alias("offset"))
    placed = counted.withColumn("within", F.coalesce(F.sum("count").over(inside), F.lit(0)))
    return placed.join(offsets, "block").select("bucket", (F.col("offset") + F.col("within")).alias("first"))


@dataclass(frozen=True)
class ShuffledCorpus:
    """``rows``: the written buckets (bucket, place, row).  ``starts``: the manifest (bucket, first)."""

    rows: DataFrame
    starts: DataFrame
    count: int
    shards: int

    def placed(self, *columns: Column) -> DataFrame:
        """The given columns of every row, with ``shard`` and ``slot``; shards differ by at most one row.

        Columns are taken before the manifest is joined, so only they travel where it is too large to broadcast.
        """
        position = F.col("first") + F.col("place")
        narrow = self.rows.select("bucket", "place", F.struct(*columns).alias("kept"))
        joined = narrow.join(self.starts, "bucket").withColumn("position", position)
        shard = F.expr(f"cast(position * {self.shards} div {max(self.count, 1)} as int)")
        begin = F.expr(f"(cast(shard as bigint) * {self.count} + {self.shards - 1}) div {self.shards}")
        return joined.withColumn("shard", shard).select("kept.*", "shard", (F.col("position") - begin).alias("slot"))

    def shard(self, number: int) -> DataFrame:
        """The documents of one shard in their order; only the buckets that it reaches into are read."""
        begin, end = (-(-at * self.count // self.shards) for at in (number, number + 1))
        last = F.max(F.when(F.col("first") < end, F.col("bucket")))
        low, high = self.starts.agg(F.max(F.when(F.col("first") <= begin, F.col("bucket"))), last).first()
        near = self.rows.where(F.col("bucket").between(low, high)).join(self.starts, "bucket")
        position = F.col("first") + F.col("place")
        return near.where((position >= begin) & (position < end)).orderBy("bucket", "place").select("row.*")


def shuffled(
    documents: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES
) -> ShuffledCorpus:
    """Shuffles whole documents and writes them; an empty table gives empty shards.

    Null or empty texts, rows without an id and rows that repeat are records like any others.  The same rows read in
    the same order give the same result.
    """
    rows = stored(shuffled_buckets(documents, seed, bucket_count(documents, bucket_bytes)))
    starts = stored(manifest(rows))
    return ShuffledCorpus(rows, starts, rows.count(), shards)


def sharded(documents: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row, from the written buckets.

    Shards hold equal numbers of rows, one more or less.  With another number of shards rows move between all of them, so
    ``grown_shard`` is null.
    """
    text = F.col("row.text").cast("string")
    corpus = shuffled(documents, shards, seed)
    placed = corpus.placed(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        record_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    law, grown = F.lit(LAW).alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)
