"""Quality classifier by positive-unlabelled learning.

Documents become shares and rates that do not depend on their language: case, symbols, repetition, lengths.  Each is
cut into ranges, so the model is a sum of one step function per feature.  It minimises the non-negative unbiased risk:
trusted positives against unlabelled documents, whose share of positives (the class prior) is estimated from how both are
ranked by a first model.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorledger.llm.joins import text_key
from floorledger.llm.language import held_out, in_training
from floorledger.llm.scratch import stored

# Positives, and unlabelled rows, that the risk is minimised over, about; a sample by hash where there are more.
FIT_ROWS = 20_000
# Quantiles between which the ranges of a feature lie, finer at both ends.
CUTS = (0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.25, 0.35, 0.5, 0.65, 0.75, 0.85, 0.92, 0.96, 0.98, 0.99, 0.995)
ROUNDS, RATE, SHRINK = 500, 0.1, 1e-4
THRESHOLD = 0.3

FEATURES = (
    "words", "chars_per_word", "upper", "digits", "spaces", "stops", "other_signs", "non_ascii", "bars", "shouts",
    "distinct_words", "distinct_pairs", "same_as_last", "most_common", "distinct_lines", "sign_ends", "capital_starts",
    "short_words", "packed",
)

_KINDS = np.zeros(256, dtype=np.int64)
for _kind, _bytes in enumerate(
    (
        b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \n\t\r", b".,;:'\"-()",
        b"#$%&*+/<=>@[\\]^_`{}~", bytes(range(128, 256)), b"|", b"!?",
    ),
    1,
):
    _KINDS[list(_bytes)] = _kind
_SIGNS = frozenset(b"#$%&*!|@^~")


def features(text: str | None) -> list[float]:
    """Shares and rates of a whole text; all zero for one without words."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    size, n = len(raw), len(words)
    kinds = np.bincount(_KINDS[np.frombuffer(raw, dtype=np.uint8)], minlength=9) / size
    upper, digits, spaces, stops, signs, high, bars, shouts = kinds[1:]
    counts: dict[bytes, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    lines = [line for line in raw.split(b"\n") if line]
    return [
        float(np.log1p(n)), (size - n) / n, upper, digits, spaces, stops, signs, high, bars, shouts,
        len(counts) / n, len(set(zip(words, words[1:]))) / max(1, n - 1),
        sum(map(bytes.__eq__, words, words[1:])) / n, max(counts.values()) / n,
        len(set(lines)) / len(lines), sum(word[-1] in _SIGNS for word in words) / n,
        sum(word[:1].isupper() for word in words) / n, sum(len(word) < 3 for word in words) / n,
        len(zlib.compress(raw, 1)) / size,
    ]


def feature_table(documents: DataFrame) -> DataFrame:
    """``doc_id, key, features`` for every row; ``key`` tells texts of one doc_id apart."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            values = pa.array([features(text.as_py()) for text in part.column(2)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), values], ["doc_id", "key", "features"])

    chosen = documents.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("key"), F.col("text").cast("string"))
    return chosen.mapInArrow(rows, "doc_id long, key long, features array<double>")


@dataclass
class QualityModel:
    """``weights``: one per range of each feature, feature after feature, and a last one for all rows."""

    edges: list[np.ndarray]
    weights: np.ndarray
    prior: float = 1.0

    def ranges(self, values: np.ndarray) -> np.ndarray:
        """For each feature the number of the weight that the value's range has; the last one for every row."""
        first = np.cumsum([0, *(len(edges) + 1 for edges in self.edges)])
        found = [np.searchsorted(edges, values[:, at], side="right") for at, edges in enumerate(self.edges)]
        return np.stack([*found, np.zeros(len(values), dtype=np.int64)], axis=1) + first

    @property
    def size(self) -> int:
        return sum(len(own) + 1 for own in self.edges) + 1

    def score(self, values: np.ndarray) -> np.ndarray:
        return _chance(self.weights[self.ranges(values)].sum(axis=1))


def _chance(logits: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def _descend(size: int, slope, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after so many steps of gradient descent with adapted step sizes."""
    weights, mean, square = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, rounds + 1):
        now = slope(weights) + SHRINK * weights
        mean, square = 0.9 * mean + 0.1 * now, 0.999 * square + 0.001 * now**2
        weights = weights - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return weights


def _mean_per_weight(ranges: np.ndarray, by_row: np.ndarray, size: int) -> np.ndarray:
    each = np.repeat(by_row, ranges.shape[1])
    return np.bincount(ranges.ravel(), weights=each, minlength=size) / len(ranges)


def separating_weights(p: np.ndarray, u: np.ndarray, size: int) -> np.ndarray:
    """Weights that tell positives from unlabelled rows by logistic risk."""

    def slope(weights: np.ndarray) -> np.ndarray:
        at_p, at_u = _chance(weights[p].sum(axis=1)), _chance(weights[u].sum(axis=1))
        return _mean_per_weight(u, at_u, size) - _mean_per_weight(p, 1 - at_p, size)

    return _descend(size, slope)


def ranks_of(of_p: np.ndarray) -> np.ndarray:
    """Scores of positives at which shares are compared, from sorted ones."""
    return of_p[np.unique(np.linspace(0, 0.7 * (len(of_p) - 1), 200).astype(int))]


def bounded_prior(of_p: np.ndarray, above_u: np.ndarray, unlabelled: int) -> float:
    """Share of positives among so many unlabelled rows.

    For every rank, the share of unlabelled rows at or above it is at least the prior times the share of positives there;
    the tightest such bound, sampling error included, gives the prior.  ``above_u`` has these shares by rank.
    """
    above_p = 1 - np.searchsorted(of_p, ranks_of(of_p), side="left") / len(of_p)
    error = np.sqrt(np.log(20) / (2 * len(of_p))) + np.sqrt(np.log(20) / (2 * unlabelled))
    best = np.argmin((above_u + error) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.99))


def estimated_prior(p: np.ndarray, u: np.ndarray, size: int) -> float:
    """The prior from rows at hand: one half of them is used to rank the other."""
    weights = separating_weights(p[::2], u[::2], size)
    of_p, of_u = (np.sort(weights[rows[1::2]].sum(axis=1)) for rows in (p, u))
    if not len(of_p) or not len(of_u):
        return 0.5
    return bounded_prior(of_p, 1 - np.searchsorted(of_u, ranks_of(of_p), side="left") / len(of_u), len(of_u))


def risk_and_slope(p: np.ndarray, u: np.ndarray, prior: float, weights: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Risk of positives, risk of negatives, and the direction in which the non-negative risk is followed."""
    of_p, of_u = weights[p].sum(axis=1), weights[u].sum(axis=1)
    at_p, at_u = _chance(of_p), _chance(of_u)
    # Logistic risks: positives as such, and as negatives; unlabelled as negatives.
    positive = prior * np.logaddexp(0, -of_p).mean()
    negative = np.logaddexp(0, of_u).mean() - prior * np.logaddexp(0, of_p).mean()
    size = len(weights)
    as_negative = _mean_per_weight(u, at_u, size) - prior * _mean_per_weight(p, at_p, size)
    # A risk of negatives below zero is overfitting: it is raised again, and nothing else, until it is not.
    slope = as_negative - prior * _mean_per_weight(p, 1 - at_p, size) if negative >= 0 else -as_negative
    return positive, negative, slope


def fit(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, edges: list[np.ndarray] | None = None
) -> QualityModel | None:
    """None without positives or unlabelled rows: nothing can be learned then."""
    if not len(positive) or not len(unlabelled):
        return None
    if edges is None:
        both = np.concatenate([positive, unlabelled])
        edges = [np.unique(np.quantile(both[:, at], CUTS)) for at in range(both.shape[1])]
    model = QualityModel(edges, np.zeros(0))
    p, u = model.ranges(positive), model.ranges(unlabelled)
    model.prior = estimated_prior(p, u, model.size) if prior is None else prior
    model.weights = _descend(model.size, lambda weights: risk_and_slope(p, u, model.prior, weights)[2])
    return model


# --- what all training rows say --------------------------------------------------------------------------------


def _per_task(table: DataFrame, count, schema: str) -> pa.Table:
    """Rows (slot, rows) that tasks count over all feature values, added up."""

    def tasks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        for part in parts:
            values = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            for slot, n in count(values):
                totals[slot] = totals.get(slot, 0) + n
        columns = zip(*((*slot, n) for slot, n in totals.items())) if totals else ()
        names = [name.split()[0] for name in schema.split(", ")]
        types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
        arrays = [pa.array(column, types[name.split()[1]]) for column, name in zip(columns, schema.split(", "))]
        if arrays:
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = table.select("features").mapInArrow(tasks, schema)
    *keys, n = [name.split()[0] for name in schema.split(", ")]
    return rows.groupBy(*keys).agg(F.sum(n).alias(n)).toArrow()


def whole_edges(table: DataFrame) -> list[np.ndarray]:
    """Edges of each feature's ranges: quantiles over all rows, of values rounded to three digits, so that the counts
    behind them are bounded by the digits and not by the rows."""

    def rounded(values: np.ndarray) -> Iterator[tuple[tuple[int, float], int]]:
        for at in range(values.shape[1]):
            size = 10.0 ** (np.floor(np.log10(np.where(values[:, at] > 0, values[:, at], 1))) - 2)
            found, n = np.unique(np.round(values[:, at] / size) * size, return_counts=True)
            yield from (((at, float(value)), int(times)) for value, times in zip(found, n))

    counts = _per_task(table, rounded, "feature int, value double, rows long")
    feature, value, rows = (counts.column(name).to_numpy() for name in ("feature", "value", "rows"))
    edges = []
    for at in range(len(FEATURES)):
        order = np.argsort(value[feature == at])
        own, n = value[feature == at][order], rows[feature == at][order]
        places = np.searchsorted(np.cumsum(n), np.rint(np.array(CUTS) * (n.sum() - 1)), side="right") if len(own) else []
        edges.append(np.unique(own[places]) if len(own) else np.empty(0))
    return edges


def whole_prior(table: DataFrame, model: QualityModel, of_p: np.ndarray) -> float:
    """The prior over all rows of the table, ranked by a model; ``of_p`` are sorted scores of positives that it has not
    seen."""
    ranks = ranks_of(of_p)

    def above(values: np.ndarray) -> Iterator[tuple[tuple[int], int]]:
        passed = np.searchsorted(ranks, model.weights[model.ranges(values)].sum(axis=1), side="right")
        found, n = np.unique(passed, return_counts=True)
        yield from (((int(at),), int(times)) for at, times in zip(found, n))

    counts = _per_task(table, above, "passed int, rows long")
    rows = np.zeros(len(ranks) + 1)
    rows[counts.column("passed").to_numpy()] = counts.column("rows").to_numpy()
    return bounded_prior(of_p, np.cumsum(rows[::-1])[::-1][1:] / rows.sum(), int(rows.sum()))


def _sample(rows: DataFrame, fit_rows: int, salt: int) -> np.ndarray:
    """All rows, or where there are more than ``fit_rows`` about so many, by a hash of their id."""
    n = rows.count()
    if n > fit_rows:
        slots = 2**31
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(slots)) < int(slots * fit_rows / n))
    found = rows.select("features").toArrow().column("features").combine_chunks()
    return found.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def learn_quality(table: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> QualityModel | None:
    """From the features of documents that are not held out; trusted positives are those that a label calls 1.

    The ranges of the features and the class prior come from all of them.  The risk is minimised over ``fit_rows`` positives
    and as many unlabelled rows, about, drawn by hash.
    """
    training = table.where(in_training(F.col("doc_id")))
    trusted = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long")).distinct()
    positive = _sample(training.join(trusted, "doc_id"), fit_rows, 1)
    unlabelled = _sample(training, fit_rows, 2)
    if not len(positive) or not len(unlabelled):
        return None
    ranking = QualityModel(whole_edges(training), np.zeros(0))
    p, u = ranking.ranges(positive), ranking.ranges(unlabelled)
    ranking.weights = separating_weights(p[::2], u, ranking.size)
    unseen = np.sort(ranking.weights[p[1::2]].sum(axis=1))
    prior = whole_prior(training, ranking, unseen) if len(unseen) else 0.5
    return fit(positive, unlabelled, prior, ranking.edges)


def score_table(table: DataFrame, model: QualityModel | None, threshold: float = THRESHOLD) -> DataFrame:
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            values = np.array(part.column(3).to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
            score = model.score(values) if model else np.full(len(values), 0.5)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(score), pa.array(score >= threshold).cast(pa.int32()), part.column(2)],
                ["doc_id", "held_out", "score", "predicted", "key"],
            )

    chosen = table.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "key", "features")
    return chosen.mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int, key long")


def score_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, key`` for every row; ``key`` tells texts of one doc_id apart.

    Null text counts as empty; rows without an id are scored but not learned from.  Without any trusted positive every
    score is 0.5, so nothing is rejected.
    """
    table = stored(feature_table(documents))
    return score_table(table, learn_quality(table, labels))
