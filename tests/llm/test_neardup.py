import random

import numpy as np

from floorledger.llm.graphs import components as connected
from floorledger.llm.neardup import _crossing, _texts, near_duplicates, shingles
from floorledger.llm.scratch import stored
from tests.llm.plain import components, documents, shingle_set


def variants(n, length=60, edits=4, seed=1):
    chance = random.Random(seed)
    base = [f"w{chance.randrange(10**6)}" for _ in range(length)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(chance.randrange(edits + 1)):
            own[chance.randrange(length)] = f"e{chance.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_components_agree_with_all_pairs(spark):
    hot = " ".join(f"shared{n}" for n in range(45))
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, "x " * 3000)]
    texts += [(100 + n, text) for n, text in enumerate(variants(80))]
    texts += [(300 + n, text) for n, text in enumerate(variants(40, 200, 12, 2))]
    texts += [(500 + n, hot + " " + " ".join(f"own{n}_{m}" for m in range(n % 30))) for n in range(60)]
    texts += [(700, "One two"), (701, "é " * 40), (702, "É " * 40)]
    found = near_duplicates(documents(spark, texts)).collect()
    wanted = components(texts)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found} == {
        (i, len(shingle_set(t)), wanted[i], wanted[i] == i) for i, t in texts
    }
    assert len(found) == len(texts)


def test_pages_of_one_template_are_not_paired(spark):
    page = "this page shows the public profile of one member with the number u{0} v{0}"
    texts = [(n, page.format(n)) for n in range(3000)] + [(5000 + n, page.format(n) + " today") for n in range(3)]
    found = {r.doc_id: r.component_id for r in near_duplicates(documents(spark, texts)).collect()}
    assert all(found[n] == n for n in range(3, 3000))
    assert {n: found[n] for n in (0, 5000, 5001)} == {n: components([(i, t) for i, t in texts if i < 3 or i >= 5000])[n] for n in (0, 5000, 5001)}
    sets = {n: [hash(("page", k)) for k in range(8)] + [hash((n, k)) for k in range(2)] for n in range(3000)}
    rows = [(n, n, np.array(own, dtype=np.int64).tobytes()) for n, own in sets.items()]
    members = spark.createDataFrame(rows, "node long, component long, hashes binary")
    assert _crossing(members, 75).count() == 0


def test_lists_beyond_the_broadcast_bound(spark):
    texts = [(1, None), (2, ""), (3, "one two")] + [(100 + n, text) for n, text in enumerate(variants(60))]
    bound = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(bound)
    spark.conf.set(bound, "-1")
    try:
        rows = documents(spark, [*texts, (None, "no id"), (103, "another text")])
        chosen = _texts(rows, stored(spark.createDataFrame([(2,), (103,), (900,)], "node long")))
        plan = chosen._jdf.queryExecution().executedPlan().toString()
        # The filter lies below the join that shuffles texts.
        assert 0 <= plan.index("SortMergeJoin") < plan.index("BroadcastHashJoin")
        wanted = dict(texts)
        assert sorted(map(tuple, chosen.collect())) == sorted([(2, ""), (103, wanted[103]), (103, "another text")])
        found = {r.doc_id: r.component_id for r in near_duplicates(documents(spark, texts)).collect()}
    finally:
        spark.conf.set(bound, before)
    assert found == components(texts)


def test_null_and_repeated_ids(spark):
    text = " ".join(map(str, range(30)))
    rows = near_duplicates(documents(spark, [(None, text), (1, text), (1, text), (2, text), (1, "else")])).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in rows), key=str) == [
        (1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (None, None, True),
    ]
    assert near_duplicates(documents(spark, [])).collect() == []


def test_shingles_count_like_tuples():
    for text in (None, "", "a", "A b c d", "a b c d e f a b c d e f", "x\u00a0y z\x85w"):
        assert len(shingles(text)) == len(shingle_set(text))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(n, n + 1) for n in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    found = {row.node: row.component for row in connected(links).collect()}
    assert found == {n: 0 for n in range(61)} | {100: 100, 101: 100}
