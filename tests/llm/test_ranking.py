"""Ranked search against a plain scorer, and the classes that it scores once."""

import math
import re
from collections import Counter

import pytest

from floorledger.llm import ranking
from floorledger.llm.ranking import bag_classes, bags, ranked, term_list, vectors
from tests.llm.plain import LOWER, documents

ITEMS = "item_id long, text string, number string, score int"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(texts, items, top=20):
    """Scores of every document for every item, by the rule as it is written."""
    own = [(i, Counter(terms(t)), len(terms(t))) for i, t in texts]
    n_docs, n_terms = sum(n > 0 for _, _, n in own), sum(n for _, _, n in own)
    df = Counter(term for _, bag, _ in own for term in bag)
    out = []
    for item, text in items:
        scores = []
        for i, bag, n in own:
            score = 0
            for term in terms(text):
                if term in bag:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    m = 75 + (25 * n * n_docs) // n_terms
                    score += w * ((10**9 * bag[term]) // (1000 * bag[term] + 12 * m))
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def found(spark, texts, items, **more):
    rows = ranked(documents(spark, texts), spark.createDataFrame([(*i, "x", 1) for i in items], ITEMS), **more)
    assert rows.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, rows.collect()), key=str)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa Ünïcode ЖУК the the the of of a1 b2".split()


def corpus_of(count):
    """Texts of repeating patterns, many of them equal bags in another order."""
    pick = lambda n: [WORDS[(n * k * k + 3 * k) % len(WORDS)] for k in range(1, 4 + n % 9)]
    return [(n, " ".join(pick(n % 37)) if n % 2 else "; ".join(reversed(pick(n % 37)))) for n in range(count)]


def test_against_the_plain_scorer(spark):
    texts = corpus_of(300)
    items = [(1, "Alpha beta, GAMMA the the"), (2, "жук Ünïcode ünïcode"), (3, "nothing known"), (4, None), (None, "iota kappa")]
    assert found(spark, texts, items) == plain(texts, items)
    assert found(spark, texts, items, top=3) == plain(texts, items, 3)


def test_one_class_of_a_third_of_all_rows(spark):
    texts = [(1000 - n, "beta alpha" if n % 2 else "alpha, beta!") for n in range(120)] + corpus_of(200)
    items = [(1, "alpha"), (2, "beta alpha alpha zeta")]
    assert found(spark, texts, items) == plain(texts, items)


def test_awkward_rows(spark):
    texts = [
        (1, None), (2, ""), (3, "?!"), (None, "alpha"), (4, "alpha"), (4, "alpha"), (4, "beta"), (5, "alpha " * 50_000),
        (6, "x" * 100_000 + " alpha"), (7, "a\x00alpha\x00"), (8, "ALPHAK"),
    ]
    items = [(1, "alpha"), (2, ""), (3, "beta kK"), (4, "alpha" * 10)]
    assert found(spark, texts, items) == plain(texts, items)
    assert found(spark, [], items) == [] and found(spark, texts, []) == []


def test_items_in_several_blocks(spark, monkeypatch):
    texts, items = corpus_of(150), [(n, f"{WORDS[n]} {WORDS[-n]}") for n in range(7)]
    monkeypatch.setattr(ranking, "ITEMS_PER_BLOCK", 3)
    assert found(spark, texts, items) == plain(texts, items)
    monkeypatch.setattr(ranking, "CELLS_PER_BLOCK", 4)
    assert found(spark, texts, items) == plain(texts, items)


def test_equal_bags_are_one_class_and_a_hash_alone_is_none(spark):
    texts = corpus_of(200)
    vocabulary = {term.encode(): n for n, term in enumerate(sorted({t for _, x in texts for t in terms(x)}))}
    own = vectors(bags(documents(spark, texts), vocabulary), 200, 1000)
    classes = bag_classes(own).collect()
    kinds = {(tuple(sorted(Counter(terms(t)).items())), 75 + 25 * len(terms(t)) * 200 // 1000) for _, t in texts if terms(t)}
    assert len(classes) == len(kinds) < 100
    clash = bag_classes(own.withColumn("hash", own.m * 0))
    assert clash.count() == len(kinds)


@pytest.mark.parametrize("text", ["", "aB9 éK x y", " a\x0bb\x85c", "A" * 10 + "\x7fz"])
def test_terms_of_bytes_are_those_of_characters(text):
    assert [term.decode() for term in term_list(text.encode())] == terms(text)
