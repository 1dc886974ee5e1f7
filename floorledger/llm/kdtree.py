"""Exact top-k by inner product with a KD-tree per shard.

Vectors are dealt to shards of a few thousand by hash.  Each shard is split at medians into leaves with tight bounding
boxes; a leaf is stored as one row.  A query first searches its own shard; the k-th score found there is carried to all
other shards, where leaves are visited best bound first and left out once their bound is below the k-th score so far.
Queries meet shards in blocks, so a task holds one shard and one block of queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorledger.llm.scratch import stored

SCALE, TOP, QUERY_EVERY = 64, 20, 20
SHARD_ROWS, LEAF_ROWS, BLOCK_ROWS = 4096, 256, 1024

# Below this, sums of products are exact in double arithmetic.
_EXACT = 2**53
_LONG = (-(2**63), 2**63 - 1)


def quantised(embedding: Column, scale: int) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def _usable(embedding: Column) -> Column:
    finite = F.forall(
        embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    return embedding.isNotNull() & F.coalesce(finite, F.lit(False))


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``; rows without an id or with a null or non-finite component take no part.

    Of rows that repeat an id, the smallest vector counts.
    """
    usable = vectors.where(F.col("vec_id").isNotNull() & _usable(F.col("embedding")))
    return usable.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(
        F.min(quantised(F.col("embedding"), scale)).alias("v")
    )


def median_leaves(points: np.ndarray, leaf_rows: int) -> list[np.ndarray]:
    """Row numbers of each leaf: split at the median of the widest side until a part is small enough."""
    leaves, parts = [], [np.arange(len(points))]
    while parts:
        part = parts.pop()
        own = points[part]
        spread = own.max(axis=0) - own.min(axis=0) if own.shape[1] else np.zeros(1)
        if len(part) <= leaf_rows or not spread.any():
            leaves += [part[at : at + leaf_rows] for at in range(0, len(part), leaf_rows)]
            continue
        middle = len(part) // 2
        order = np.argpartition(own[:, spread.argmax()], middle)
        parts += [part[order[middle:]], part[order[:middle]]]
    return leaves


def products(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """All inner products as integers; sums beyond a long stay at its limits."""
    most = one.shape[1] * float(np.abs(one).max(initial=0)) * float(np.abs(two).max(initial=0))
    if most < _EXACT:
        return (one.astype(np.float64) @ two.astype(np.float64).T).astype(np.int64)
    exact = one.astype(object) @ two.astype(object).T
    return np.clip(exact, *_LONG).astype(np.int64)


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query and box, the largest inner product that a point of the box can have."""
    # Positive components meet the upper side of the box, negative ones the lower side.
    signed = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1)
    return products(signed, np.concatenate([high, low], axis=1))


def search(
    queries: np.ndarray, own_ids: np.ndarray, least: np.ndarray, leaves: list[tuple[np.ndarray, np.ndarray]], k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best-first over the leaves for all queries of a block at once.

    ``least`` is each query's k-th score known so far, and is raised as leaves are seen.  Returns query number, id and
    score of what can still be among the best k, and the raised scores.
    """
    low = np.array([rows.min(axis=0) for _, rows in leaves])
    high = np.array([rows.max(axis=0) for _, rows in leaves])
    bound = bounds(queries, low, high)
    order = np.argsort(-bound, axis=1, kind="stable")
    least, best = least.copy(), np.full((len(queries), k), _LONG[0], dtype=np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    active = np.arange(len(queries))
    for step in range(len(leaves)):
        # A query whose next leaf cannot reach its k-th score is done: later leaves have lower bounds.
        active = active[bound[active, order[active, step]] >= least[active]]
        if not len(active):
            break
        at = order[active, step]
        by_leaf = np.argsort(at, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(at[by_leaf]) > 0])
        for part in np.split(by_leaf, starts[1:]):
            asking, (ids, rows) = active[part], leaves[at[part[0]]]
            scores = products(queries[asking], rows)
            good = (scores >= least[asking, None]) & (ids[None, :] != own_ids[asking, None])
            who, what = np.nonzero(good)
            found.append((asking[who], ids[what], scores[who, what]))
            both = np.concatenate([best[asking], np.where(good, scores, _LONG[0])], axis=1)
            best[asking] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            least[asking] = np.maximum(least[asking], best[asking].min(axis=1))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), least
    who, ids, scores = (np.concatenate(column) for column in zip(*found, strict=True))
    still = scores >= least[who]
    who, ids, scores = who[still], ids[still], scores[still]
    order = np.lexsort((ids, -scores, who))
    who, ids, scores = who[order], ids[order], scores[order]
    rank = np.arange(len(who)) - np.searchsorted(who, who)
    return who[rank < k], ids[rank < k], scores[rank < k], least


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


_LEAVES = "size int, shard int, ids array<long>, rows array<long>, least array<long>"


def leaf_index(vectors: DataFrame, shards: int, k: int, query_every: int, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """One row per leaf: its ids, its vectors end to end, and for each id that is a query its k-th score in the shard
    (else the smallest long)."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        size = key[0].as_py()
        ids, points = table.column("vec_id").to_numpy(), _matrix(table.column("v"), size)
        leaves = [(ids[rows], points[rows]) for rows in median_leaves(points, leaf_rows)]
        asking = np.flatnonzero(ids % query_every == 0)
        least = np.full(len(ids), _LONG[0], dtype=np.int64)
        if len(asking):
            least[asking] = search(points[asking], ids[asking], least[asking], leaves, k)[3]
        order = np.argsort(ids)
        return pa.table(
            {
                "size": pa.array([size] * len(leaves), pa.int32()),
                "shard": pa.array([key[1].as_py()] * len(leaves), pa.int32()),
                "ids": pa.array([own for own, _ in leaves], pa.list_(pa.int64())),
                "rows": pa.array([rows.ravel() for _, rows in leaves], pa.list_(pa.int64())),
                "least": pa.array(
                    [least[order[np.searchsorted(ids, own, sorter=order)]] for own, _ in leaves], pa.list_(pa.int64())
                ),
            }
        )

    dealt = vectors.select(
        F.size("v").alias("size"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "v"
    )
    return dealt.groupBy("size", "shard").applyInArrow(build, _LEAVES)


def top_k(
    vectors: DataFrame,
    k: int = TOP,
    scale: int = SCALE,
    query_every: int = QUERY_EVERY,
    shard_rows: int = SHARD_ROWS,
    leaf_rows: int = LEAF_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``query_every`` its best ``k`` others.

    Components are floor(scale * x).  Equal scores rank by smaller id; vectors meet those of their own length only.
    An empty table, or one with a single usable row, gives no rows.
    """
    whole = stored(integer_vectors(vectors, scale))
    shards = max(1, -(-whole.count() // shard_rows))
    blocks = max(1, -(-whole.where(F.pmod("vec_id", F.lit(query_every)) == 0).count() // block_rows))
    index = stored(leaf_index(whole, shards, k, query_every, leaf_rows))

    entry = F.explode(F.arrays_zip("ids", F.sequence(F.lit(0), F.size("ids") - 1).alias("at"), "least")).alias("entry")
    queries = (
        index.select("size", "rows", entry)
        .where(F.pmod("entry.ids", F.lit(query_every)) == 0)
        .select(
            "size", F.col("entry.ids").alias("query_id"), F.col("entry.least").alias("least"),
            F.slice("rows", F.col("entry.at") * F.col("size") + 1, F.col("size")).alias("v"),
        )
    )
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    asked = queries.select("size", block, "query_id", "least", "v", everywhere)
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    offered = index.select("size", "shard", "ids", "rows", every_block)
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def meet(key: tuple, leaves: pa.Table, asking: pa.Table) -> pa.Table:
        if not len(leaves) or not len(asking):
            return out.empty_table()
        size, ids = key[0].as_py(), asking.column("query_id").to_numpy()
        rows = [
            (np.array(own.as_py(), dtype=np.int64), np.array(flat.as_py(), dtype=np.int64).reshape(len(own), size))
            for own, flat in zip(leaves.column("ids"), leaves.column("rows"), strict=True)
        ]
        least = asking.column("least").to_numpy()
        who, found, scores, _ = search(_matrix(asking.column("v"), size), ids, least, rows, k)
        return pa.table([ids[who], found, scores], schema=out)

    keys = ["size", "shard", "block"]
    pairs = offered.groupBy(*keys).cogroup(asked.groupBy(*keys))
    met = pairs.applyInArrow(meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
