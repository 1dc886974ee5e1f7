import os
import random
import subprocess
import sys
from collections import Counter

import numpy as np

from floorledger.llm.language import (
    STRAY_RATIO, contained_trigrams, identify_languages, judge, learn_languages, letters, slots, trigrams,
)
from floorledger.llm.tables import corpus
from tests.llm.plain import documents, is_held_out


def test_held_out_accuracy(spark):
    rows = corpus(spark, "/root/testdata/sf0.001", "documents")
    truth = {row.doc_id: row.lang for row in rows.collect()}
    found = identify_languages(rows).collect()
    assert {row.doc_id for row in found} == set(truth) and len(found) == len(truth)
    assert all(row.held_out == is_held_out(row.doc_id) and 0 <= row.score <= 1 for row in found)
    own = [row for row in found if row.held_out]
    assert sum(row.lang_pred == truth[row.doc_id] for row in own) >= 0.95 * len(own)


def test_awkward_rows(spark):
    english = [(n, "the and with of this that from") for n in range(1, 30)]
    german = [(n, "der und mit von das dass für über") for n in range(30, 60)]
    learned = documents(spark, english, "en").unionByName(documents(spark, german, "de"))
    odd = documents(spark, [(100, None), (101, ""), (102, "123 !?"), (103, "ÜBER das"), (None, "the and"), (104, "漢字"), (104, "漢字")], None)
    found = identify_languages(learned.unionByName(odd)).collect()
    assert sorted(((r.doc_id, r.lang_pred) for r in found if r.doc_id is None or r.doc_id >= 100), key=str) == [
        (100, "und"), (101, "und"), (102, "und"), (103, "de"), (104, "en"), (104, "en"), (None, "en"),
    ]
    assert [r.held_out for r in found if r.doc_id is None] == [False]


def test_nothing_to_learn_from(spark):
    assert [tuple(r)[2:] for r in identify_languages(documents(spark, [(1, "a text")], None)).collect()] == [("und", 0.0)]
    assert identify_languages(documents(spark, [])).collect() == []


ENGLISH = "the and with of this that from was not have they which one you were her all she there would their".split()


def plain_trigrams(text):
    """Trigrams of the letters, other characters as one blank, none with a blank in the middle."""
    held = "".join(c if c.isalpha() else "\0" for c in f" {text.lower()} ")
    return [held[at : at + 3] for at in range(len(held) - 2) if held[at + 1] != "\0"]


def test_filters_hold_what_a_plain_count_holds(spark):
    draw = random.Random(4)
    texts = {lang: [" ".join("".join(draw.choice(abc) for _ in range(4)) for _ in range(20)) for _ in range(30)]
             for lang, abc in (("aa", "abcdeé"), ("bb", "defgh"), ("cc", "漢字仮名交文"))}
    texts["bb"] += ["abab abab"]
    rows = spark.createDataFrame([(lang, t) for lang, own in texts.items() for t in own] + [(None, "zzz")], "lang string, text string")
    counts = {lang: Counter(g for t in own for g in plain_trigrams(t)) for lang, own in texts.items()}
    rate = lambda lang, gram: counts[lang][gram] / counts[lang].total()
    wanted = {
        lang: {g for g in own if rate(lang, g) * STRAY_RATIO >= max(rate(other, g) for other in counts)}
        for lang, own in counts.items()
    }
    is_letter = letters()
    contained, sizes = contained_trigrams(rows)
    assert sizes == {lang: own.total() for lang, own in counts.items()}
    assert Counter(r.lang for r in contained.collect()) == Counter({lang: len(own) for lang, own in wanted.items()})
    filters = learn_languages(rows)
    for number, lang in enumerate(filters.languages):
        for text in texts[lang][:30]:
            grams = plain_trigrams(text)
            one, two = slots(trigrams([text], is_letter)[1], filters.slot_bits)
            found = (filters.masks[one, 0] & filters.masks[two, 0]) >> np.uint64(number) & np.uint64(1)
            assert all(hit for hit, gram in zip(found, grams, strict=True) if gram in wanted[lang])
            names, _ = judge([text], filters, is_letter)
            hits = {other: sum(g in wanted[other] for g in grams) for other in wanted}
            assert names == [max(sorted(hits), key=hits.get)]
    assert filters.chance.max() <= 1 / 64


def test_a_language_of_many_characters_keeps_its_rare_trigrams(spark):
    draw = random.Random(1)
    chinese = [(n, "".join(chr(0x4E00 + draw.randrange(4000)) for _ in range(30))) for n in range(1000)]
    english = [(5000 + n, " ".join(draw.choice(ENGLISH) for _ in range(30))) for n in range(1000)]
    rows = documents(spark, chinese, "zh").unionByName(documents(spark, english, "en"))
    found = {r.doc_id: r.lang_pred for r in identify_languages(rows).collect()}
    learned = [i for i, _ in chinese if not is_held_out(i)]
    assert learned and all(found[i] == "zh" for i in learned)
    assert all(found[i] == "en" for i, _ in english)


def test_ties_and_very_long_texts(spark):
    rows = documents(spark, [(1, "abc abc"), (2, "the " * 200_000)], "bb").unionByName(documents(spark, [(3, "abc abc"), (4, "der " * 50)], "aa"))
    learned = [i for i in (1, 2, 3, 4) if not is_held_out(i)]
    found = {r.doc_id: r.lang_pred for r in identify_languages(rows.unionByName(documents(spark, [(None, "the"), (None, "der der")], None))).collect()}
    assert len(found) == 5 and set(found.values()) <= {"aa", "bb"}
    if {1, 3} <= set(learned):
        assert found[1] == found[3] == "aa"  # the language that sorts first


def test_workers_need_no_copy_of_the_library(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(
        f"import sys; sys.path.insert(0, {os.getcwd()!r})\n"
        "from floorledger.session import local_session\n"
        "from floorledger.llm.language import identify_languages\n"
        "spark = local_session('2', 2, '1g')\n"
        "rows = spark.createDataFrame([(n, 'the and of', 'en') for n in range(9)], 'doc_id long, text string, lang string')\n"
        "print(identify_languages(rows).where(\"lang_pred = 'en'\").count())\n",
        encoding="utf-8",
    )
    env = {key: value for key, value in os.environ.items() if key != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert done.stdout.strip() == "9", done.stderr[-2000:]
