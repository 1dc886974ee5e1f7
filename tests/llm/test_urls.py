from floorledger.llm import urls
from floorledger.llm.urls import Rule, TreeSettings, url_verdicts

PAGES = "page_id long, url string, html string, host string, bad int, template string"
LABELS = "page_id long, bad boolean, extra string"


def pages(spark, rows):
    return spark.createDataFrame([(i, url, "h", "x", 1, "t") for i, url in rows], PAGES)


def judged(spark, rows, labels=(), **more):
    marks = spark.createDataFrame([(i, bad, "e") for i, bad in labels], LABELS)
    return {row.page_id: row for row in url_verdicts(pages(spark, rows), marks, **more).collect()}


def test_host_path_and_longest_rule(spark):
    found = judged(spark, [
        (1, "http://A.Example.NET/en/x?q#f"), (2, "https://example.net/de/"), (3, "http://xexample.net/en/1"), (4, None),
        (5, "no scheme"), (6, "http://b.org/fr/é"), (7, "http://org/fr/"), (8, "http://a.com/x://y/"), (9, "ftp://example.com"),
        (10, "http://ÉX.Example.com/de/A"), (11, "http://a.net"), (12, "x\n://a.org?fr/"),
    ])
    assert {i: (row.host, row.path, row.rule, row.verdict) for i, row in found.items()} == {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow"),
        2: ("example.net", "/de/", "net/", "block"),
        3: ("xexample.net", "/en/1", "net/", "block"),
        4: ("", "", None, "allow"),
        5: ("", "", None, "allow"),
        6: ("b.org", "/fr/é", "org/fr/", "allow"),
        7: ("org", "/fr/", "org/fr/", "allow"),
        8: ("a.com", "/x://y/", None, "allow"),
        9: ("example.com", "", None, "allow"),
        10: ("Éx.example.com", "/de/A", "example.com/de/", "block"),
        11: ("a.net", "", None, "allow"),
        12: ("a.org", "", None, "allow"),
    }


def test_templates_generalise_merge_and_reject(spark):
    rows, labels = [], []
    for n in range(40):
        rows += [(n, f"http://h.test/ads/{n}"), (100 + n, f"http://h.test/news/{n}.html"), (200 + n, f"http://h.test/blog/{n}.html")]
        labels += [(n, True), (100 + n, n % 10 == 0), (200 + n, n % 10 == 1)]
    rows += [(300, "http://h.test/ads/unseen"), (301, "http://h.test/news/unseen.html"), (302, "http://h.test/" + "a/" * 30)]
    rows += [(0, "http://h.test/ads/0")]  # a repeated row
    found = judged(spark, rows, [*labels, (None, True), (5, None)])
    assert found[300].verdict == found[0].verdict == "block" and found[300].template == "/ads/*"
    assert found[301].verdict == "allow" and found[302].verdict == "allow"
    assert found[301].template == found[200].template == "/*/*.html"  # alike, so one branch


def test_repeated_rows_stay_and_empty_tables_give_none(spark):
    rows = [(1, "http://a.test/x"), (1, "http://a.test/x"), (None, "http://a.test/y")]
    marks = spark.createDataFrame([], LABELS)
    assert url_verdicts(pages(spark, rows), marks).count() == 3
    assert url_verdicts(pages(spark, []), marks, (Rule("block", "net", "/"),), TreeSettings(levels=2)).collect() == []


def test_sections_that_part_below_the_fourth_segment_keep_their_own_verdict(spark):
    for stem in ("/shop/a/b/c", "/shop/a/b/c/d/e"):
        rows, labels = [(999, "http://h.test/" + "deep/" * 200)], []
        for n in range(30):
            rows += [(n, f"http://h.test{stem}/good/{n}"), (100 + n, f"http://h.test{stem}/spam/{n}")]
            labels += [(n, False), (100 + n, True)] if n < 20 else []
        found = judged(spark, rows, labels)
        assert {(found[n].template, found[n].verdict) for n in range(30)} == {(f"{stem}/good/*", "allow")}
        assert {(found[100 + n].template, found[100 + n].verdict) for n in range(30)} == {(f"{stem}/spam/*", "block")}
        assert found[999].template == "/deep" * 200


def rounds(monkeypatch, work):
    """How many tables a piece of work stores."""
    count = []
    stored = urls.stored
    monkeypatch.setattr(urls, "stored", lambda frame: (count.append(1), stored(frame))[1])
    result = work()
    monkeypatch.undo()
    return len(count), result


def test_deep_paths_cost_no_more_rounds_than_shallow_ones(spark, monkeypatch):
    def of(depth):
        stem = "".join(f"/s{n}" for n in range(depth))
        rows = [(n, f"http://h.test{stem}/{kind}/{n}") for n in range(20) for kind in ("good", "spam")]
        rows += [(100 + n, "http://trap.test" + "".join(f"/{n}x{k}" for k in range(depth * 5))) for n in range(2)]
        rows += [(200 + n, f"http://h.test{stem}/good/deeper{stem}/{n}") for n in range(6)]
        return rounds(monkeypatch, lambda: judged(spark, rows)), stem

    (shallow, _), _ = of(10)
    (deep, found), stem = of(60)
    assert deep <= shallow
    assert found[0].template in (f"{stem}/good/*", f"{stem}/*/*") and found[200].template.endswith(f"/deeper{stem}/*")
    assert found[101].template == "".join(f"/1x{k}" for k in range(300))


def test_passing_levels_over_changes_nothing(spark):
    rows, labels = [], []
    for n in range(60):
        for stem in ("/a/b", "/a/c/d/e", "/x/y/z/u/v/w", f"/t{n % 7}/k/{n % 3}", f"/q/{n % 9}/r/{n}"):
            rows.append((len(rows), f"http://h{n % 2}.test{stem}/{'id' if n % 4 else 'no'}{n}/p{n % 5}.html"))
            labels.append((len(labels), (n * 7 + len(stem)) % 5 == 0))
    results = [
        {i: (r.template, r.purity, r.verdict) for i, r in judged(spark, rows, labels, settings=TreeSettings(jump_from=at)).items()}
        for at in (0, 2, 100)
    ]
    assert results[0] == results[1] == results[2]
    assert len({template for template, _, _ in results[0].values()}) > 5
