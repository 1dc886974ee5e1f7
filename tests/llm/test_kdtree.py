import numpy as np

from floorledger.llm.kdtree import products, top_k

VECTORS = "vec_id long, embedding array<float>, label int, v int, size int, ids string"


def table(spark, rows):
    return spark.createDataFrame([(i, e, 0, 1, 2, "i") for i, e in rows], VECTORS)


def plain(rows, k=20, every=20):
    usable = {}
    for i, e in rows:
        if i is None or e is None or any(x is None or not np.isfinite(np.float32(x)) for x in e):
            continue
        v = tuple(int(np.floor(64 * float(np.float32(x)))) for x in e)
        usable[i] = min(v, usable.get(i, v))
    out = []
    for q, one in usable.items():
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(one, two)), i) for i, two in usable.items() if i != q and len(one) == len(two))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_top_k_agrees_with_all_products(spark):
    chance = np.random.default_rng(5)
    rows = [(n, list(map(float, chance.normal(size=6)))) for n in range(-40, 400)]
    rows += [(1000 + n, [0.5, 0.5, 0.5, 0.5, 0.5, 0.5]) for n in range(200)]  # ties
    rows += [(2000, None), (2020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2040, [float("nan")] * 6), (2060, [float("inf")] * 6)]
    rows += [(None, [1.0] * 6), (40, [9.0] * 6), (20, rows[60][1]), (3000, [1.0, 2.0]), (3001, [2.0, 1.0]), (3020, []), (3040, [])]
    found = top_k(table(spark, rows), shard_rows=100, leaf_rows=16, block_rows=10).collect()
    assert sorted(map(tuple, found)) == plain(rows)


def test_few_rows_and_none(spark):
    assert top_k(table(spark, [(0, [1.0])])).collect() == []
    assert top_k(table(spark, [])).collect() == []
    found = top_k(table(spark, [(0, [1.0]), (7, [-2.0])])).collect()
    assert list(map(tuple, found)) == [(0, 1, 7, -8192)]


def test_products_are_exact_beyond_doubles():
    one, two = np.array([[2**31, 1]]), np.array([[2**30, 1], [2**40, 0]])
    assert products(one, two).tolist() == [[2**61 + 1, 2**63 - 1]]
