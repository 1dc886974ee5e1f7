import pytest

from floorledger.llm.licenses import NOTICES, PHRASES, TEMPLATES, licenses, rivals, runs_of, wider
from tests.llm.plain import documents, words

NOTICE = "Licensed under the Apache License, Version 2.0."


def expected(text):
    own, places, base = words(text), [], set()
    for phrase, label in PHRASES.items():
        wanted = phrase.split()
        for at in range(len(own) - len(wanted) + 1):
            if own[at : at + len(wanted)] == wanted:
                places.append(at)
                base.add(label)
    score, stride = float(bool(places)), max(len(t.words) for t in TEMPLATES)
    met = []
    for at in range(0, len(own), stride):
        block = own[at : at + 2 * stride]
        for n, template in enumerate(TEMPLATES):
            shared = len(template.tokens & set(block))
            held = len(template.runs & runs_of(tuple(block), template.run_words))
            if not template.base and shared >= template.needed and held >= template.needed_runs:
                met.append((at // stride, n, held / len(template.runs), shared / len(template.tokens)))
    near, beyond = rivals(TEMPLATES), wider(TEMPLATES)
    beaten = lambda one: any(
        o[1] in near[one[1]] and abs(o[0] - one[0]) <= 1 and (o[1] in beyond[one[1]] or o[2] > one[2] and one[1] not in beyond[o[1]])
        for o in met
    )
    kept = [one for one in met if not beaten(one)]
    labels = base | {TEMPLATES[one[1]].label for one in kept}
    score = max([score, *[one[3] for one in kept]])
    return (len(own), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), score)


def test_licenses_agree_with_a_plain_scan(spark):
    texts = [
        (1, None), (2, ""), (3, "..."), (4, "x " * 500 + "ALL rights\nreserved é" + " y" * 300 + " cc by"),
        (5, NOTICE), (6, "licensed under the license version 2"), (7, "CC BY cc-by; by cc"), (None, NOTICE),
        (8, "General Public license " * 400), (9, "reserved rights all"), (10, "the " * 1000),
        (11, "a " * 39 + "this work is licensed under the gnu general public license version 3 " + "b " * 50),
        (5, NOTICE), (5, "another text of the same id, all rights reserved"),
    ]
    found = sorted(map(tuple, licenses(documents(spark, texts)).collect()), key=str)
    assert found == sorted([(i, *expected(t)) for i, t in texts], key=str)


FALSE = {
    "licensed under the GNU General Public License version 2.0": "gpl",
    "licensed under CC BY 4.0": "cc-by",
    "Released under the Apache license.": "",
    "The MIT laboratory was released from the contract under which the state had granted a license.": "",
    "It is redistribution in source and in binary, use of forms are with modification or without, permitted the following "
    "conditions provided that met and met": "",
}


def test_words_alone_are_no_notice(spark):
    texts = list(enumerate(FALSE))
    found = {row.doc_id: row.labels for row in licenses(documents(spark, texts)).collect()}
    assert [found[i] for i, _ in texts] == list(FALSE.values())


@pytest.mark.parametrize("before", [0, 100, 333])
def test_every_notice_is_found_whole_and_marred(spark, before):
    cases, padding = [], " ".join(f"w{n % 50}" for n in range(before))
    for label, texts in NOTICES.items():
        for text in texts:
            own = text.split()
            marred = [w for n, w in enumerate(own) if n % 25 != 24]  # a word in 25 lost
            cases += [(label, text), (label, " ".join(marred))]
    rows = [(n, f"{padding} {text} {padding}") for n, (_, text) in enumerate(cases)]
    found = {row.doc_id: set(row.labels.split(",")) - set(PHRASES.values()) for row in licenses(documents(spark, rows)).collect()}
    for n, (label, _) in enumerate(cases):
        assert found[n] == {label}, (label, found[n], rows[n])


def test_two_notices_side_by_side(spark):
    two = "released under the MIT license or, at your option, licensed under the Apache License, Version 2.0"
    versions = NOTICES["gpl-2.0"][0] + " " + NOTICES["gpl-3.0"][1]
    found = {row.doc_id: row.labels for row in licenses(documents(spark, [(1, two), (2, versions)])).collect()}
    assert found == {1: "apache-2.0,mit", 2: "gpl,gpl-2.0,gpl-3.0"}


def test_no_documents_no_rows(spark):
    assert licenses(documents(spark, [])).collect() == []
