import os

import pytest

import corpus_pipeline
from floorledger.llm.neardup import near_duplicates
from floorledger.llm.scratch import stored
from tests.llm.plain import DOCS, components, documents, hits

DIRECTORY = "/root/testdata/sf0.001"


def test_stages_decide_and_the_last_packs(spark):
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet")
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIRECTORY}/benchmark.parquet").collect()]
    states = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        states.append(stored(stage(spark, states[-1], DIRECTORY)))
        assert states[-1].columns == docs.columns
    texts = [[(r.doc_id, r.text) for r in state.collect()] for state in states]
    assert len(texts[1]) >= 0.75 * len(texts[0])
    low = components(texts[1])
    assert {i for i, _ in texts[2]} == {i for i, _ in texts[1] if low[i] == i}
    assert {i for i, _ in texts[3]} == {i for i, t in texts[2] if not hits(t, benchmark)[1]}
    before, after = dict(texts[3]), dict(texts[4])
    assert before.keys() == after.keys()
    changed = [i for i in before if before[i] != after[i]]
    assert changed and all("[SECRET]" in after[i] for i in changed)
    assert all(r.n_chars == len(r.text) for r in states[4].collect() if r.doc_id in changed)
    packed = corpus_pipeline.STAGES[-1][1](spark, states[4], DIRECTORY)
    assert {r.doc_id for r in packed.collect()} == set(after)


COLUMNS = [c.split()[0] for c in DOCS.split(", ")]
CLASHES = "1 as row, 2 as doc, 3 as key, 4 as listed, 5 as redactions, 6 as _word, 7 as score, 8 as kept"


def test_stages_take_awkward_and_empty_tables(spark):
    rows = documents(spark, [(1, None), (2, ""), (None, "no id"), (3, "plain words"), (3, "plain words"), (4, "x " * 20_000)])
    for frame, ids in ((rows.select(*COLUMNS).selectExpr("*", *CLASHES.split(", ")), {1, 2, None, 3, 4}), (rows.limit(0), set())):
        docs = frame
        for _, stage in corpus_pipeline.STAGES[1:-1]:
            docs = stage(spark, docs, DIRECTORY)
            assert {r.doc_id for r in docs.collect()} == ids and docs.columns == frame.columns
        judged = corpus_pipeline.good_quality(spark, frame, DIRECTORY)
        assert judged.columns == frame.columns and {r.doc_id for r in judged.collect()} <= ids
        assert {r.doc_id for r in corpus_pipeline.packed(spark, docs, DIRECTORY).collect()} <= ids
    assert near_duplicates(rows).count() == 6


@pytest.mark.parametrize("threshold", ["10485760b", "-1"])
def test_decisions_are_about_an_id_and_its_text(spark, threshold):
    passage = spark.read.parquet(f"{DIRECTORY}/benchmark.parquet").first().text
    base = " ".join(f"w{n}" for n in range(40))
    texts = [(None, passage), (7, "a clean text"), (7, passage), (None, "a clean text"), (8, None)]
    groups = [
        (1, base), (1, base), (2, base + " more"), (3, "another text of its own"), (3, "yet a different text here"), (4, ""), (4, ""),
        (None, base), (None, base), (5, base.upper()), (6, "one only"),
    ]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        left = corpus_pipeline.not_in_benchmark(spark, documents(spark, texts), DIRECTORY)
        assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(
            [(7, "a clean text"), (None, "a clean text"), (8, None)], key=str
        )
        kept = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, documents(spark, groups), DIRECTORY).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((i for i, _ in kept), key=str) == [1, 3, 4, 4, 6, None, None]
    assert set(kept) <= set(groups)


def test_what_a_run_stores_on_its_way_is_removed(spark):
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    folders = lambda: set(os.listdir(root.removeprefix("file:")))
    before = folders()
    packed = corpus_pipeline.run(spark, DIRECTORY)
    assert packed.count() > 0
    # The documents after each stage, and what the last one reads.
    assert len(folders() - before) <= len(corpus_pipeline.STAGES) + 2
