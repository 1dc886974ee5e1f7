import math

import numpy as np

from floorledger.llm.quality import (
    CUTS, FEATURES, QualityModel, bounded_prior, estimated_prior, features, fit, ranks_of, risk_and_slope, score_quality,
    whole_edges, whole_prior,
)
from floorledger.llm.tables import corpus
from tests.llm.plain import documents, is_held_out

LABELS = "doc_id long, quality int, toxic int, features string"


def test_held_out_labels(spark):
    directory = "/root/testdata/sf0.01"
    labels = {row.doc_id: row.quality for row in corpus(spark, directory, "labels").collect()}
    found = score_quality(corpus(spark, directory, "documents"), corpus(spark, directory, "labels")).collect()
    assert len(found) == 1000 and all(row.held_out == is_held_out(row.doc_id) for row in found)
    assert all(0 <= row.score <= 1 and row.predicted == int(row.score >= 0.3) for row in found)
    known = [row for row in found if row.held_out and row.doc_id in labels]
    good = [row.score for row in known if labels[row.doc_id] == 1]
    bad = [row.score for row in known if labels[row.doc_id] == 0]
    ranked = sum(g > b for g in good for b in bad) / (len(good) * len(bad))
    assert ranked >= 0.97
    assert sum(g >= 0.3 for g in good) >= 0.98 * len(good)


def test_prior_is_found_and_negatives_are_rejected():
    chance = np.random.default_rng(2)
    shape = len(FEATURES)
    positive = chance.normal(size=(4000, shape))
    mixed = np.concatenate([chance.normal(size=(3500, shape)), chance.normal(3, 1, size=(1500, shape))])
    model = fit(positive, mixed)
    assert abs(model.prior - 0.7) < 0.06
    score = model.score(mixed)
    assert (score[:3500] > 0.5).mean() > 0.95 and (score[3500:] < 0.5).mean() > 0.9
    p, u = model.ranges(positive), model.ranges(positive[:2000])
    assert estimated_prior(p, u, len(model.weights)) > 0.9


def plain_risk(p, u, prior, weights):
    """The risk row by row, as it is defined."""
    loss = lambda x: math.log1p(math.exp(-x))
    score = lambda row: sum(weights[at] for at in row)
    positive = prior * sum(loss(score(row)) for row in p) / len(p)
    negative = sum(loss(-score(row)) for row in u) / len(u) - prior * sum(loss(-score(row)) for row in p) / len(p)
    return positive, negative


def test_the_risk_and_its_slope_agree_with_a_plain_sum():
    chance = np.random.default_rng(4)
    p, u = (
        np.stack([chance.integers(low, low + 2, n), chance.integers(3, 7, n), np.full(n, 7)], axis=1) for low, n in ((0, 20), (1, 30))
    )
    seen = set()
    cases = [(chance.normal(scale=2, size=8), float(chance.uniform(0.1, 0.9))) for _ in range(10)]
    cases += [(np.array([6, -6, -6, 0, 0, 0, 0, 0]) + chance.normal(size=8), 0.9)]  # negatives told apart too well
    for weights, prior in cases:
        positive, negative, slope = risk_and_slope(p, u, prior, weights)
        assert np.allclose((positive, negative), plain_risk(p, u, prior, weights))
        followed = lambda w: sum(plain_risk(p, u, prior, w)) if negative >= 0 else -plain_risk(p, u, prior, w)[1]
        steps = [(followed(weights + 1e-6 * e) - followed(weights - 1e-6 * e)) / 2e-6 for e in np.eye(8)]
        assert np.allclose(slope, steps, atol=1e-5)
        seen.add(negative >= 0)
    assert seen == {True, False}


def test_edges_and_prior_come_from_all_rows(spark):
    chance = np.random.default_rng(6)
    values = chance.normal(size=(3000, len(FEATURES))) ** 2
    table = spark.createDataFrame([(n, list(map(float, row))) for n, row in enumerate(values)], "doc_id long, features array<double>").repartition(5)
    edges = whole_edges(table)
    for at, own in enumerate(edges):
        assert np.allclose(own, np.quantile(values[:, at], CUTS), rtol=0.02)
    model = QualityModel(edges, np.zeros(0))
    model.weights = chance.normal(size=model.size)
    of_all = model.weights[model.ranges(values)].sum(axis=1)
    of_p = np.sort(of_all[:700])
    above = np.array([(of_all >= rank).mean() for rank in ranks_of(of_p)])
    assert whole_prior(table, model, of_p) == bounded_prior(of_p, above, 3000)


def test_awkward_rows(spark):
    rows = documents(spark, [(1, None), (2, ""), (3, "x" * 100_000), (None, "text"), (4, "a b"), (4, "a b"), (5, "\n\n")])
    marks = spark.createDataFrame([(4, 1, 0, "f"), (4, 1, 0, "f"), (3, None, None, "f"), (None, 1, 0, "f"), (99, 1, 0, "f")], LABELS)
    assert score_quality(rows, marks).count() == 7
    unlabelled = score_quality(rows, spark.createDataFrame([], LABELS)).collect()
    assert {(row.score, row.predicted) for row in unlabelled} == {(0.5, 1)}
    assert score_quality(documents(spark, []), marks).collect() == []


def test_features_are_shares():
    assert features(None) == features(" \n") == [0.0] * len(FEATURES)
    assert len(features("é A. b|c\nd")) == len(FEATURES)


def test_compressibility_covers_the_middle_of_a_long_text():
    chance = np.random.default_rng(3)
    plain = " ".join(f"{n:x}" for n in chance.integers(0, 2**40, size=3000))
    ends = plain[:4096], plain[-4096:]
    packed = [features(ends[0] + middle + ends[1])[-1] for middle in (plain[4096:-4096], "spam " * 4000)]
    assert packed[1] < 0.6 * packed[0]
    below, above = features(plain[:8192])[-1], features(plain[:8193])[-1]
    assert abs(below - above) < 0.001
    assert abs(features(plain)[-1] - below) < 0.05
