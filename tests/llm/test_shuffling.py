"""Sharding: the law, an exact replay of both passes, awkward rows."""

import random
import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from floorledger.llm.shuffling import bucket_count, manifest, shuffled, shuffled_buckets, sharded
from floorledger.llm.tables import corpus
from tests.llm.plain import documents


def spark_hash(seed, number):
    """Spark's hash of two longs: the first one's, from 42, is the seed of the second."""
    of = lambda value, start: xxhash.xxh64_intdigest(value.to_bytes(8, "little", signed=True), start)
    return of(number, of(seed, 42))


def generator(seed):
    """The 32-bit twister that an array of the seed's two halves starts."""
    return random.Random((seed & 0xFFFFFFFF) << 32 | seed >> 32)


def below(draw, n):
    """A number under n: a power of two takes the top bits, others are drawn again until they are even."""
    if n & (n - 1) == 0:
        return n * draw.getrandbits(31) >> 31
    while True:
        bits = draw.getrandbits(31)
        value = bits % n
        if bits - value + n - 1 < 1 << 31:
            return value


def fisher_yates(items, seed):
    draw, out = generator(seed), [None] * len(items)
    for at, item in enumerate(items):
        other = below(draw, at + 1)
        out[at] = out[other]
        out[other] = item
    return out


def test_both_passes_replayed(spark):
    texts = [(n, f"text {n}") for n in range(500)]
    rows = shuffled_buckets(documents(spark, texts).coalesce(1), 11, 7).collect()
    found = defaultdict(dict)
    for row in rows:
        found[row.bucket][row.place] = row.row.doc_id
    dealt = defaultdict(list)
    for number in range(500):
        hashed = spark_hash(11, number)
        dealt[(hashed - (hashed >> 63 << 64)) % 7].append(number)
    assert {b: [of[n] for n in range(len(of))] for b, of in found.items()} == {
        b: fisher_yates(numbers, 11 + b) for b, numbers in dealt.items()
    }


def check_law(rows, texts, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts
    )
    slots = defaultdict(list)
    for row in rows:
        slots[row.shard].append(row.slot)
        assert row.law == "rows" and row.grown_shard is None
    counts = [len(slots.get(shard, [])) for shard in range(shards)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    assert all(sorted(of) == list(range(len(of))) for of in slots.values())


def test_awkward_rows(spark):
    texts = [(1, None), (1, None), (None, ""), (None, "é😀"), (2, "x" * 200_000), (3, "a\x00b"), *[(4, "same")] * 100]
    check_law(sharded(documents(spark, texts)).collect(), texts, 24)
    check_law(sharded(documents(spark, texts[:3])).collect(), texts[:3], 24)
    assert sharded(documents(spark, [])).collect() == []


def test_many_buckets_and_reading_a_shard(spark):
    texts = [(n % 50, f"text {n % 20}" * (n % 9)) for n in range(700)]
    docs = documents(spark, texts)
    result = shuffled(docs, shards=9, bucket_bytes=512)
    assert bucket_count(docs, 512) > 40 and result.rows.select("bucket").distinct().count() > 40
    placed = result.placed(F.col("row.doc_id"), F.col("row.text"))
    by_shard = defaultdict(list)
    for row in sorted(placed.collect(), key=lambda row: (row.shard, row.slot)):
        by_shard[row.shard].append((row.doc_id, row.text))
    for shard in range(9):
        read = result.shard(shard)
        assert read.columns == docs.columns
        assert [(r.doc_id, r.text) for r in read.collect()] == by_shard[shard]
    assert Counter(pair for of in by_shard.values() for pair in of) == Counter(texts)


def test_offsets_over_several_blocks(spark):
    rows = spark.range(20_000).selectExpr("cast(id % 9001 as int) as bucket", "0 as place")
    first = {r.bucket: r.first for r in manifest(rows).collect()}
    at = 0
    for bucket in range(9001):
        assert first[bucket] == at
        at += 3 if bucket < 20_000 - 2 * 9001 else 2


def test_same_seed_same_order_other_seed_other_order(spark):
    docs = corpus(spark, "/root/testdata/sf0.001", "documents")
    order = lambda seed: [(r.shard, r.slot) for r in sorted(sharded(docs, seed=seed).collect(), key=lambda r: r.doc_id)]
    one, again, other = order(5), order(5), order(6)
    assert one == again and sum(a == b for a, b in zip(one, other)) < 20

