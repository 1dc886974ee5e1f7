"""Resampling against a plain draw, and quickselect against sorting."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from floorledger.llm.resampling import bucket_counts, kth_key, ranks, resampled
from tests.llm.plain import documents, words

COMMON = "the of and to in is that it was for on are as with his they at be this from".split()


def features(text):
    found = words(text)
    return found + [f"{a} {b}" for a, b in zip(found, found[1:])]


def buckets(text):
    return [zlib.crc32(feature.encode()) % 10_000 for feature in features(text)]


def plain(texts, target):
    """The draw by the rule as it is written; ties beyond the id go by position."""
    s, t = Counter(), Counter()
    for _, text in texts:
        s.update(buckets(text))
    for text in target:
        t.update(buckets(text))
    whole, wanted = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (whole + 10_000) / ((s[b] + 1) * (wanted + 10_000))))
    rows = []
    for at, (i, text) in enumerate(texts):
        own = [gain(b) for b in buckets(text)]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(own), weight, score, len(words(text)) >= 20, at))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[5]))
    drawn = {r[5]: rank for rank, r in enumerate(able[: 25 * len(able) // 100], 1)}
    return sorted(((*r[:4], drawn.get(r[5])) for r in rows), key=str)


def target(spark, texts):
    return spark.createDataFrame([(n, t, "b", 1) for n, t in enumerate(texts)], "item_id long, text string, bucket string, row int")


def found(spark, texts, wanted):
    rows = resampled(documents(spark, texts).coalesce(1), target(spark, wanted))
    assert rows.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, rows.collect()), key=str)


def some_texts(count, seed=1):
    draw = random.Random(seed)
    return [(n, " ".join(draw.choice(COMMON) + draw.choice(["", "é", "X9"]) for _ in range(draw.randint(1, 60)))) for n in range(count)]


def test_against_a_plain_draw(spark):
    texts, wanted = some_texts(400), ["the of and to in", "That was! His x9", None]
    assert found(spark, texts, wanted) == plain(texts, wanted)


def test_awkward_rows(spark):
    long = " ".join(COMMON * 4000)
    texts = [(1, None), (2, ""), (3, "?!"), (None, " ".join(COMMON)), (4, long), (5, "A\x00b \x7f c" * 30), (6, "x" * 100_000)]
    texts += [(7, " ".join(COMMON))] * 40 + [(None, None)]
    assert found(spark, texts, [" ".join(COMMON)]) == plain(texts, [" ".join(COMMON)])
    assert found(spark, texts, []) == plain(texts, [])
    assert found(spark, [], ["a"]) == [] and [r[4] for r in found(spark, texts[:3], ["a"])] == [None] * 3


def test_counts_of_buckets(spark):
    texts = some_texts(50)
    counts = np.zeros(10_000, dtype=np.int64)
    for _, text in texts:
        np.add.at(counts, buckets(text), 1)
    assert (bucket_counts(documents(spark, texts).repartition(7)) == counts).all()


@pytest.mark.parametrize("kind", ["different", "few scores", "one score"])
def test_the_kth_key_and_the_ranks(spark, kind):
    draw = random.Random(3)
    spread = {"different": 10**6, "few scores": 3, "one score": 1}[kind]
    keys = [(draw.randrange(spread), draw.randrange(5 if spread == 1 else 10**6), row) for row in range(3000)]
    draw.shuffle(keys)
    frame = spark.createDataFrame(keys, "lacking long, id long, row long").repartition(5).cache()
    keys.sort()
    for k in (1, 2, 33, 1500, 2999, 3000):
        assert kth_key(frame, k) == keys[k - 1]
    assert kth_key(frame.limit(1), 1) == tuple(frame.limit(1).first())
    ranked = ranks(frame, 3000).collect()
    assert [tuple(r)[:3] for r in sorted(ranked, key=lambda r: r["rank"])] == keys
    assert sorted(r["rank"] for r in ranked) == list(range(1, 3001))


def test_ranks_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr("floorledger.llm.resampling.WINNERS_PER_TASK", 100)
    frame = spark.range(1000).selectExpr("id % 7 as lacking", "id div 3 as id", "id as row")
    ranked = sorted(ranks(frame, 1000).collect(), key=lambda r: r["rank"])
    assert [tuple(r)[:3] for r in ranked] == sorted(tuple(r)[:3] for r in ranked) and ranked[-1]["rank"] == 1000
