import hashlib
from collections import Counter

from pyspark.sql import functions as F

from floorledger.llm.decontamination import contamination, matches, positional_index
from floorledger.llm.words import words as split_words
from tests.llm.plain import documents, hits, words

PASSAGE = "The quick brown fox jumps over the lazy dog while seven wizards watch from a distant hill."
ITEMS = [(1, PASSAGE), (2, "Tiny item"), (3, None), (4, "..."), (2, "other words under one id"), (None, "no id"), (5, "the the the the the the the the the the the")]


def items(spark, rows):
    return spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "item_id long, text string, window int, word string")


def test_contamination_agrees_with_all_windows(spark):
    texts = [
        (1, None), (2, ""), (3, "Intro. " + PASSAGE.upper() + " tail"), (4, "tiny\nITEM, tiny item"), (5, "no id"), (None, PASSAGE),
        (6, "brown fox jumps over the lazy dog while seven wizards"), (7, "fox jumps over the lazy dog while seven wizards"),
        (8, "the " * 5000), (9, (PASSAGE + " ") * 300), (10, PASSAGE.replace("lazy", "sleepy")), (3, "Intro. " + PASSAGE.upper() + " tail"),
        (7, "another text of one id with tiny item"),
    ]
    known = [(i, t) for i, t in ITEMS if i is not None]
    wanted = []
    for i, t in texts:
        n, hit, found = hits(t, known)
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        wanted.append((i, n, hit, len(found), digest, hit > 0))
    got = contamination(documents(spark, texts), items(spark, ITEMS)).drop("n_near", "key").collect()
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str)


def test_proximity_allows_a_slack(spark):
    texts = [(1, PASSAGE.replace("quick brown", "quick little brown")), (2, PASSAGE), (3, "nothing alike")]
    index = positional_index(documents(spark, texts), items(spark, [(1, PASSAGE)]))
    exact = {(r.doc, r.window) for r in matches(index).collect()}
    near = {(r.doc, r.window) for r in matches(index, slack=1).collect()}
    assert {doc for doc, _ in exact} == {1, 2} and exact < near
    assert len([1 for doc, _ in near if doc == 1]) == len([1 for doc, _ in exact if doc == 2])


def near_places(texts, passages, slack):
    """Places by text number where a window's words stand up to ``slack`` off, but not all just there."""
    own = [words(t) for _, t in texts]
    often = Counter(w for each in own for w in each)
    windows = {tuple(p[at : at + 10]) for p in map(words, passages) for at in range(max(1, len(p) - 9)) if p}
    found = Counter()
    for window in windows:
        rarest = min(range(len(window)), key=lambda at: (often[window[at]], at))
        for number, each in enumerate(own):
            for start in (pos - rarest for pos, w in enumerate(each) if w == window[rarest]):
                near = lambda at: window[at] in each[max(0, start + at - slack) : max(0, start + at + slack + 1)]
                if all(map(near, range(len(window)))) and (start < 0 or tuple(each[start : start + len(window)]) != window):
                    found[number] += 1
    return found


def test_proximity_matches_agree_with_a_plain_search(spark):
    swapped = PASSAGE.lower().replace("brown fox", "fox brown")
    texts = [(0, PASSAGE), (1, swapped), (2, PASSAGE.replace("quick brown", "quick little brown")), (3, None), (4, "the fox"),
             (5, "w0 w2 w1 w3 w4 w5 w6 w7 w8 w9"), (6, "w1 w0 w3 w2 w4 w5 w6 w7 w8 w9 w1"), (7, "w1 w2 w3 w4 w5 w6 w7 w8 w9"),
             (8, "w3 w4 tiny little item " * 50)]
    passages = [PASSAGE, " ".join(f"w{n}" for n in range(10)), "tiny item"]
    rows = contamination(documents(spark, texts), items(spark, list(enumerate(passages)))).collect()
    wanted = near_places(texts, passages, 1)
    assert {r.doc_id: r.n_near for r in rows} == {i: wanted[i] for i, _ in texts}
    assert wanted[1] and wanted[2] and wanted[5] and wanted[8]


def test_proximity_at_the_head_of_a_text(spark):
    texts = [(n, f"w3 {n}") for n in range(2)] + [(10, "w0 w1 w3 w2 w4 w5 w6 w7 w8 w9")]
    texts += [(20 + n, "w0 w1 w2 w4 w5 w6 w7 w8 w9 pad " * 3) for n in range(3)]
    index = positional_index(documents(spark, texts), items(spark, [(1, " ".join(f"w{n}" for n in range(10)))]))
    found = [(r.doc, r.start, r.exact) for r in matches(index, slack=2).collect()]
    assert found == [(10, -1, False)]


def test_empty_tables(spark):
    assert contamination(documents(spark, []), items(spark, ITEMS)).collect() == []
    row = contamination(documents(spark, [(1, "a b")]), items(spark, [])).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (2, 0, 0, False)


def test_words_are_what_stands_between_separators(spark):
    texts = [None, "", " ", "a", "--a--", "A1 b2.C3\n", "\x00x\x7fy\x1fz", "Éa ÉÀ\u2028b 漢字,😀!", "[a]^{b}|\\c:d@e`f~g/h",
             "K\u212a \u0130i", *(f"a{chr(code)}b{chr(code)}" for code in range(1, 256))]
    rows = spark.createDataFrame(list(enumerate(texts)), "n INT, text STRING").select("n", split_words(F.col("text")).alias("words"))
    assert {row.n: row.words for row in rows.collect()} == {n: words(text) for n, text in enumerate(texts)}
    # A match per word costs several times what a cut between words does.
    assert "regexp_extract_all" not in rows._jdf.queryExecution().toString()
