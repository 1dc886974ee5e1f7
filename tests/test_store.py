import gzip
import os
import shutil
from concurrent.futures import ThreadPoolExecutor
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from floorledger.ledgers import DAY_COLUMN
from floorledger.operators.facts import Facts
from floorledger.plans import comps, control, options, summary
from floorledger.operators.filters import period
from floorledger.operators.replace import replace_range
from floorledger.sinks.loading import FeedsRefused, load_feeds
from floorledger.sinks.sections import SECTIONS, Section, export_sections, exported, period_name, section_frame, stored_base
from floorledger.sinks.files import Files
from floorledger.sinks.store import KEPT_NUMBERS, RECENT_LOADS, DuplicateKeys, LedgerStore
from floorledger.sources.feeds import FeedRefused, read_feed
from floorledger.sources.star import star_ledgers
from floorledger.streaming.landing import load_landing
from tests.rows import ledgers


def points(spark, rows):
    return ledgers(spark, points=[(d, str(i), tag, i) for i, (d, tag) in enumerate(rows)]).points


def pairs(frame):
    return sorted((str(r.op_date), r.client_name) for r in frame.collect())


def test_replace_range_in_the_store(spark, tmp_path):
    store = LedgerStore(spark, f"{tmp_path}/s")
    assert pairs(store.ledger("points")) == []
    first = [("1997-01-15", "a"), ("1997-02-01", "a"), ("1997-02-20", "a"), ("1997-03-02", "a"),
             ("1997-04-02", "a"), ("1997-04-20", "a"), ("1998-01-01", "a"), (None, "a")]
    assert store.replace_range("points", points(spark, first), "one") == 8
    second = points(spark, [("1997-02-10", "b"), ("1997-04-10", "b"), (None, "b")])
    expected = pairs(replace_range(store.ledger("points").drop("ledger_month"), second, "op_date"))
    assert store.replace_range("points", second, "two") == 3
    found = pairs(store.ledger("points"))
    assert found == expected
    assert found == [("1997-01-15", "a"), ("1997-02-01", "a"), ("1997-02-10", "b"), ("1997-04-10", "b"),
                     ("1997-04-20", "a"), ("1998-01-01", "a"), ("None", "a"), ("None", "b")]
    dated = points(spark, [("1997-02-10", "c"), ("1997-04-10", "c")])
    for _ in range(2):  # loading the same dated batch again changes nothing
        store.replace_range("points", dated, "three")
        assert pairs(store.ledger("points"))[2:4] == [("1997-02-10", "c"), ("1997-04-10", "c")]
    assert store.ledger("points").count() == 8
    log = store.load_log().collect()
    assert [(r.file_name, r.rows) for r in log] == [("three", 2), ("three", 2), ("two", 3), ("one", 8)]
    assert store.replace_range("points", points(spark, []), "none") == 0
    assert store.ledger("points").count() == 8


def test_months_outside_the_range_are_not_rewritten(spark, tmp_path):
    store = LedgerStore(spark, f"{tmp_path}/s")
    store.replace_range("points", points(spark, [(f"1997-{m:02d}-05", "a") for m in range(1, 7)]))
    before = dict((month, load) for load, month in store._pieces()["points"])
    store.replace_range("points", points(spark, [("1997-03-05", "b")]))
    after = dict((month, load) for load, month in store._pieces()["points"])
    assert {m for m in before if before[m] != after[m]} == {"1997-03"}


def test_unpublished_files_are_invisible(spark, tmp_path):
    store = LedgerStore(spark, f"{tmp_path}/s")
    store.replace_range("points", points(spark, [("1997-03-05", "a")]))
    # A job that died before publishing leaves files that no load names.
    store._write_months(points(spark, [("1997-03-05", "x")]), "op_date", f"{store.root}/points/load=dead")
    assert pairs(store.ledger("points")) == [("1997-03-05", "a")]


def test_period_prunes_month_partitions(spark, tmp_path):
    store = LedgerStore(spark, f"{tmp_path}/s")
    store.replace_range("points", points(spark, [(f"{y}-{m:02d}-05", "a") for y in (1997, 1998) for m in range(1, 13)]))
    ledger = store.ledger("points")
    for (anio, mes), files in {("1997", "03"): 1, ("1997", ""): 12, ("", "03"): 2}.items():
        found = period(ledger, "op_date", anio, mes)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(ledger_month" in plan or "PartitionFilters: [(substring(ledger_month" in plan
        assert found.count() == files


def test_dimension_refresh(spark, tmp_path):
    store = LedgerStore(spark, f"{tmp_path}/s")
    books = ledgers(spark, managers=[("1", "A", "MDA"), ("2", "B", "MDJ")])
    assert store.dimension("managers").count() == 0
    store.refresh("managers", books.managers)
    store.refresh("managers", books.managers.where("user_id = '2'"))
    assert [r.user_id for r in store.dimension("managers").collect()] == ["2"]


def write(path, title_rows, rows, width):
    lines = [f"title {i}" + "," * (width - 1) for i in range(title_rows)]
    for row in rows:
        cells = [""] * width
        for position, value in row.items():
            cells[position] = value
        lines.append(",".join(cells))
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")


def test_title_rows_are_skipped_in_every_file_and_only_there(spark, tmp_path):
    # Titles look like data here, so only their place tells them apart; files span several splits.
    for name, count in (("a", 5000), ("b", 1), ("c", 3000)):
        rows = [{1: "1997-03-01", 5: f"{name}{i}", 6: "N", 11: "1"} for i in range(count)]
        write(tmp_path / f"{name}.csv", 0, [{5: f"title{i}"} for i in range(2)] + rows, 12)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        raw = read_feed(spark, "points", str(tmp_path))
        splits = spark.read.text(str(tmp_path)).select("_metadata.file_path", "_metadata.file_block_start")
        assert splits.distinct().count() > 6
        ids = [r._c5 for r in raw.select("_c5").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(ids) == 8001 and len(set(ids)) == 8001 and not any(i.startswith("title") for i in ids)


def test_load_any_subset_of_feeds(spark, tmp_path):
    write(tmp_path / "play.csv", 3, [
        {1: "2024-02-01", 2: " 12.0", 3: "Ana", 4: "GOLD", 5: "abc", 10: "1.5", 16: "4"},
        {1: "x", 2: "13"}, {1: "2024-02-01", 2: "N/A"},
    ], 18)
    write(tmp_path / "comps.csv", 8, [
        {6: "2024-02-01", 7: "12", 10: "", 14: "Bar", 16: '"Té, negro"', 19: "10", 22: "QUEMADO", 28: "17.0"},
        {6: "bad", 7: "12", 22: "QUEMADO"}, {6: "2024-02-01", 7: "12", 22: "ANULADO"}, {7: "", 22: "QUEMADO"},
    ], 30)
    write(tmp_path / "prizes.csv", 2, [
        {0: "01-02-2024 08:59", 3: "xx12x", 6: "9", 11: "Jackpot HP"},
        {0: "01-02-2024 09:00", 3: "x", 6: "-", 11: "Progressive Jackpot HP"},
        {0: "01-02-2024 09:00", 3: "12", 11: "MDC Purse Clear"}, {0: "2024-02-01 09:00", 3: "12", 11: "Jackpot HP"},
    ], 13)
    write(tmp_path / "managers.csv", 1, [{0: " 17 ", 1: "", 2: "MDA"}], 3)
    write(tmp_path / "tiers.csv", 1, [{0: "Primario", 1: "0.1"}, {1: "3"}], 2)
    store = LedgerStore(spark, f"{tmp_path}/s")
    files = {f: f"{tmp_path}/{f}.csv" for f in ("play", "comps", "prizes", "managers", "tiers")}
    loaded = load_feeds(store, files)
    assert loaded == {"play": 1, "comps": 2, "prizes": 2, "managers": 1, "tiers": 1}
    books = store.ledgers()
    play = books.play.first()
    assert (play.player_id, play.coin_in, play.total_games, play.promo_in) == ("12", 0.0, 4, 1.5)
    vouchers = sorted(books.comps.collect(), key=lambda r: str(r.gaming_date))
    assert [(r.gaming_date, r.client_name, r.product, r.user_id, r.user_name) for r in vouchers] == [
        (date(2024, 2, 1), None, "Té, negro", "17", ""), (None, None, None, None, "")]
    assert sorted((str(r.gaming_date), r.client_id, r.amount) for r in books.prizes.collect()) == [
        ("2024-01-31", "12", 9.0), ("2024-02-01", "", 0.0)]
    row = comps.comps_by_player(Facts(books, "2024", "02")).first()
    assert (row.nombre_cliente, row.total_cortesias, row.monto_cortesias) == ("Ana", 1, 10.0)


def points_file(path, client, day="1997-03-01", extra=()):
    write(path, 2, [{1: day, 5: client, 11: "2"}, *extra], 12)


def clients(store):
    return sorted(r.client_id for r in store.ledger("points").collect())


def test_landing_directory_loads_each_file_once(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    store = LedgerStore(spark, f"{tmp_path}/s")
    run = lambda: load_landing(store, "points", str(landing), f"{tmp_path}/cp").awaitTermination(120)
    points_file(landing / "one.csv", "1", extra=[{5: "9", 11: "2"}])
    run()
    points_file(landing / "two.csv", "2")
    run()
    run()
    assert sorted((str(r.op_date), r.client_id) for r in store.ledger("points").collect()) == [
        ("1997-03-01", "2"), ("None", "9")]
    assert store.load_log().count() == 2


def test_equal_names_and_new_checkpoints_neither_lose_nor_repeat(spark, tmp_path):
    store = LedgerStore(spark, f"{tmp_path}/s")
    for n, place in enumerate(("a", "b"), 1):
        (tmp_path / place).mkdir()
        points_file(tmp_path / place / "points.csv", str(n), f"1997-0{n}-01", [{5: f"undated{n}"}])
    for place, checkpoint in (("a", "1"), ("b", "2"), ("a", "3")):
        load_landing(store, "points", f"{tmp_path}/{place}", f"{tmp_path}/cp{checkpoint}").awaitTermination(120)
    assert clients(store) == ["1", "2", "undated1", "undated2"]


def test_a_refused_file_fails_the_landing_and_is_not_forgotten(spark, tmp_path):
    store, landing = LedgerStore(spark, f"{tmp_path}/s"), tmp_path / "in"
    landing.mkdir()
    points_file(landing / "points.dat", "1")
    for _ in range(2):
        with pytest.raises(Exception, match="points.dat"):
            load_landing(store, "points", str(landing), f"{tmp_path}/cp").awaitTermination(120)
    assert clients(store) == []


def test_feeds_as_directories_compressed_and_columnar(spark, tmp_path):
    store, parts = LedgerStore(spark, f"{tmp_path}/s"), tmp_path / "parts"
    parts.mkdir()
    points_file(parts / "part-0.csv", "1")
    points_file(parts / "part-1.csv", "2")
    assert load_feeds(store, {"points": str(parts)}) == {"points": 2}
    packed = tmp_path / "points.csv.gz"
    packed.write_bytes(gzip.compress((parts / "part-0.csv").read_bytes()))
    assert load_feeds(store, {"points": str(packed)}) == {"points": 1}
    cells = [None, "1997-03-01", *[None] * 3, "3", "line\nbreak", *[None] * 4, "NaN"]
    spark.createDataFrame([cells], ", ".join(f"c{n} STRING" for n in range(12))).write.parquet(f"{tmp_path}/columnar")
    assert load_feeds(store, {"points": f"{tmp_path}/columnar"}) == {"points": 1}
    row = store.ledger("points").first()
    assert (row.client_id, row.client_name, row.points) == ("3", "line\nbreak", 0.0)


def test_refused_feeds_are_named_and_the_others_loaded(spark, tmp_path):
    store = LedgerStore(spark, f"{tmp_path}/s")
    points_file(tmp_path / "points.csv", "1")
    write(tmp_path / "tiers.csv", 1, [{0: "GOLD", 1: "1"}], 3)  # a column too many
    write(tmp_path / "managers.csv", 1, [{0: "17"}], 2)  # one too few
    write(tmp_path / "play.pdf", 0, [], 1)
    (tmp_path / "prizes.csv").write_text('a,"open\nquote' + "," * 11 + "\n", encoding="utf-8")
    names = {"points": "points.csv", "tiers": "tiers.csv", "managers": "managers.csv", "play": "play.pdf", "prizes": "none.csv",
             "comps": "prizes.csv"}
    with pytest.raises(FeedsRefused) as refused:
        load_feeds(store, {feed: f"{tmp_path}/{name}" for feed, name in names.items()})
    assert refused.value.loaded == {"points": 1}
    assert set(refused.value.refused) == {"tiers", "managers", "play", "prizes", "comps"}
    assert "over the end of the file" in refused.value.refused["comps"]
    assert all(names[feed] in why for feed, why in refused.value.refused.items())
    assert clients(store) == ["1"] and store.load_log().count() == 1
    with pytest.raises(ValueError, match="no such feed"):
        load_feeds(store, {"poinst": f"{tmp_path}/points.csv"})


def cells_of(rows):
    """Delimited text of the rows, cells quoted where they need it."""
    quoted = lambda c: '"' + c.replace('"', '""') + '"' if any(x in c for x in '",\n') else c
    return "".join(",".join(map(quoted, row)) + "\n" for row in rows)


@pytest.mark.parametrize("split_bytes", [40, 200, 1_000_000])
def test_cells_over_several_lines(spark, tmp_path, split_bytes):
    rows = [("ti\ntle", ""), ("GO\nLD", "1"), ("plain", "2"), ('say ""\n\n x, "hi"', "3"), ("\n" * 30 + "deep", "4")]
    rows += [(f"n{i}" if i % 5 else f"a\nb{i}\n", str(i)) for i in range(200)]
    (tmp_path / "a.csv").write_text(cells_of(rows), encoding="utf-8")
    (tmp_path / "b.csv").write_text("t,t\n" + "".join(f"even{i},{i}\n" for i in range(50)), encoding="utf-8")
    (tmp_path / "c.csv").write_bytes(b't,t\r\n"one\r\ntwo",7\r\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    try:
        found = sorted(tuple(r) for r in read_feed(spark, "tiers", str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == sorted([*rows[1:], *[(f"even{i}", str(i)) for i in range(50)], ("one\ntwo", "7")])


def test_a_quote_that_is_never_closed_is_refused(spark, tmp_path):
    (tmp_path / "tiers.csv").write_text('t,t\n"GO\nLD,1\n', encoding="utf-8")
    with pytest.raises(FeedRefused, match="over the end of the file"):
        read_feed(spark, "tiers", f"{tmp_path}/tiers.csv")


def test_lines_of_a_feed_are_not_shuffled(spark, tmp_path):
    points_file(tmp_path / "points.csv", "1")
    plan = read_feed(spark, "points", f"{tmp_path}/points.csv")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning") == 1  # the title rows, one per file


def test_doubled_keys_of_a_dimension_are_refused(spark, tmp_path):
    store = LedgerStore(spark, f"{tmp_path}/s")
    write(tmp_path / "managers.csv", 1, [{0: "17", 1: "A"}, {0: "17.0", 1: "B"}, {0: ""}, {0: ""}], 3)
    with pytest.raises(DuplicateKeys, match="17"):
        load_feeds(store, {"managers": f"{tmp_path}/managers.csv"})
    assert store.dimension("managers").count() == 0


@pytest.mark.parametrize("stored", [["2024-02-01", "2024-02-03"], ["0024-02-01", "2024-02-01", "2024-02-03"]])
def test_a_mistyped_year_still_replaces(spark, tmp_path, stored):
    store = LedgerStore(spark, f"{tmp_path}/s")
    text = lambda days: spark.createDataFrame(
        [(d, "1", "a", 1.0, 1.0) for d in days], "d STRING, client_id STRING, client_name STRING, points DOUBLE, coin_in_points DOUBLE"
    ).select(F.col("d").cast("date").alias("op_date"), "client_id", "client_name", "points", "coin_in_points")
    store.replace_range("points", text(stored))
    batch = ["0024-02-01", "2024-02-01", "2024-03-03"]
    assert store.replace_range("points", text(batch)) == 3
    found = store.ledger("points").select(F.col("op_date").cast("string")).collect()
    assert sorted(r[0] for r in found) == batch
    assert period(store.ledger("points"), "op_date", "0024", "02").count() == 1


def test_a_read_lists_and_opens_few_files_after_many_loads(spark, tmp_path):
    store = LedgerStore(spark, f"{tmp_path}/s")
    store.replace_range("points", points(spark, [("1997-03-05", "a"), (None, "a")]), "first", "source 1")
    for number in range(2, 206):
        store._publish("points", f"file {number}", f"source {number}", 1, f"id{number}", lambda live: live)
    assert store._newest() == 205
    assert len([p for p in (tmp_path / "s" / "log").iterdir() if not p.name.startswith(".")]) <= KEPT_NUMBERS
    assert pairs(store.ledger("points")) == [("1997-03-05", "a"), ("None", "a")]
    assert len(store._pieces()["points"]) == 2
    log = store.load_log()
    assert len(log.inputFiles()) == 1 and len(store._state().recent) <= RECENT_LOADS
    assert [r.file_name for r in log.collect()] == [f"file {n}" for n in range(205, 1, -1)] + ["first"]
    for number in (1, 2, 120, 205):
        assert store.has_loaded("points", f"source {number}")
    assert not store.has_loaded("points", "source 206") and not store.has_loaded("play", "source 1")
    # What the log has moved from one folder to the next can go.
    assert store.superseded().count() == 0 and store.superseded(timedelta(0)).count() == 1


def meanwhile(store, action):
    """Lets another writer publish between the reading of the state and the first try to publish."""
    create = store._files.create_new

    def late(path, text):
        store._files.create_new = create
        action()
        return create(path, text)

    store._files.create_new = late


def test_two_writers_neither_double_nor_lose_rows(spark, tmp_path):
    one, other = LedgerStore(spark, f"{tmp_path}/s"), LedgerStore(spark, f"{tmp_path}/s")
    one.replace_range("points", points(spark, [("1997-03-01", "a"), ("1997-03-20", "a"), ("1997-04-02", "a")]))
    meanwhile(one, lambda: other.replace_range("points", points(spark, [("1997-03-05", "b"), ("1997-03-10", "b"), (None, "b")])))
    one.replace_range("points", points(spark, [("1997-03-08", "c"), ("1997-03-12", "c")]))
    expected = [("1997-03-01", "a"), ("1997-03-05", "b"), ("1997-03-08", "c"), ("1997-03-12", "c"), ("1997-03-20", "a"),
                ("1997-04-02", "a"), ("None", "b")]
    assert pairs(one.ledger("points")) == pairs(other.ledger("points")) == expected
    meanwhile(one, lambda: other.refresh("managers", ledgers(spark, managers=[("1", "A", "MDA")]).managers))
    one.replace_range("points", points(spark, [("1997-03-08", "d"), ("1997-03-12", "d")]))
    assert [name for _, name in pairs(other.ledger("points"))] == list("abddaab")
    assert other.dimension("managers").count() == 1 and other.load_log().count() == 5
    # The rollup of every piece follows.
    assert one.rollup("points").agg(F.sum("table_rows")).first()[0] == 7


def test_a_delivery_that_two_landings_load_counts_once(spark, tmp_path):
    one, other = LedgerStore(spark, f"{tmp_path}/s"), LedgerStore(spark, f"{tmp_path}/s")
    batch = points(spark, [("1997-03-05", "a"), (None, "a")])
    meanwhile(one, lambda: other.replace_range("points", batch, "f", "in/f@1"))
    assert one.replace_range("points", batch, "f", "in/f@1") == 0
    assert pairs(one.ledger("points")) == [("1997-03-05", "a"), ("None", "a")] and one.load_log().count() == 1


def test_a_repeated_delivery_writes_nothing(spark, tmp_path):
    one, other = LedgerStore(spark, f"{tmp_path}/s"), LedgerStore(spark, f"{tmp_path}/s")
    batch = points(spark, [("1997-03-05", "a"), (None, "a")])
    assert one.replace_range("points", batch, "f", "in/f@1") == 2
    folders = sorted(os.listdir(f"{tmp_path}/s/points"))
    for writer in (other, one):
        assert writer.replace_range("points", batch, "f", "in/f@1") == 0
    assert sorted(os.listdir(f"{tmp_path}/s/points")) == folders and one.load_log().count() == 1
    # Without a name, or under another, the rows are a delivery of their own.
    assert other.replace_range("points", batch) == one.replace_range("points", batch, "g", "in/g@1") == 2
    assert pairs(one.ledger("points")) == [("1997-03-05", "a"), *[("None", "a")] * 3]


def test_writers_at_the_same_time(spark, tmp_path):
    days = [f"1997-03-{day:02d}" for day in range(1, 9)]

    def write(day):
        LedgerStore(spark, f"{tmp_path}/s").replace_range("points", points(spark, [(day, "a"), (day, "b")]))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, days))
    store = LedgerStore(spark, f"{tmp_path}/s")
    assert pairs(store.ledger("points")) == sorted((day, tag) for day in days for tag in "ab")
    assert store._newest() == 8 and store.load_log().count() == 8


def test_a_file_can_be_created_once(spark, tmp_path):
    files = Files(spark)
    assert files.create_new(f"{tmp_path}/log/1", "é one") and not files.create_new(f"{tmp_path}/log/1", "two")
    assert files.read(f"{tmp_path}/log/1") == "é one" and [e.name for e in files.entries(f"{tmp_path}/log")] == ["1"]
    assert files.entries(f"{tmp_path}/none") == [] and not files.delete(f"{tmp_path}/none")


def test_a_file_is_created_once_by_renaming_too(spark, tmp_path):
    # A view of the same folder under another scheme, which takes the way of shared file systems.
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./in", f"file://{tmp_path}")
    files = Files(spark)
    (tmp_path / "log").mkdir()
    assert files.create_new("viewfs://store/in/log/1", "one") and not files.create_new("viewfs://store/in/log/1", "two")
    assert files.read("viewfs://store/in/log/1") == "one" and [e.name for e in files.entries(f"{tmp_path}/log")] == ["1"]


def test_what_failed_loads_left_is_swept(spark, tmp_path, monkeypatch):
    store = LedgerStore(spark, f"{tmp_path}/s")
    store.replace_range("points", points(spark, [("1997-03-05", "a")]))
    store.refresh("managers", ledgers(spark, managers=[("1", "A", "MDA")]).managers)
    with pytest.raises(DuplicateKeys):
        store.refresh("managers", ledgers(spark, managers=[("2", "A", ""), ("2", "B", "")]).managers)
    assert [e.name for e in store._files.entries(f"{store.root}/managers")] == [f"load={store._pieces()['managers'][0][0]}"]
    # A job that dies before it publishes leaves rows and their rollup.
    monkeypatch.setattr(store, "_publish", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.replace_range("points", points(spark, [("1997-03-05", "x")]))
    monkeypatch.undo()
    assert store.clean_up() == 0 and len(store._files.entries(f"{store.root}/points")) == 2  # it may still be running
    assert store.clean_up(abandoned=timedelta(0)) == 1
    for table in ("points", "points_rollup"):
        assert len(store._files.entries(f"{store.root}/{table}")) == 1
    assert pairs(store.ledger("points")) == [("1997-03-05", "a")] and store.dimension("managers").count() == 1


def test_reports_on_a_store_read_rollups_instead_of_play(spark, tmp_path):
    star = star_ledgers(spark, "/root/testdata/sf0.001")
    days = {name: F.col(day).between("1995-05-10", "1995-07-20") | F.col(day).isNull() for name, day in DAY_COLUMN.items()}
    source = star.replaced(**{name: star[name].where(some) for name, some in days.items()})
    store = LedgerStore(spark, f"{tmp_path}/s")
    for name in ("play", "points", "prizes", "comps"):
        store.replace_range(name, source[name])
    for name in ("managers", "tiers"):
        store.refresh(name, source[name])
    half = source.play.where("gaming_date < '1995-06-15'")
    store.replace_range("play", half)  # a month in two pieces
    raw = [f"/s/{name}/" for name in ("play", "points", "prizes")]
    reports = (control.control_all, control.control_kpis, control.control_tables, summary.summary_players, summary.summary_kpis)
    for period in (("", ""), ("1995", "06")):
        on_store, on_views = Facts(store.ledgers(), *period), Facts(source, *period)
        for report in reports:
            found = report(on_store)
            assert sorted(map(str, found.collect())) == sorted(map(str, report(on_views).collect())), (report, period)
            files = found.inputFiles()
            assert any("_rollup/" in f for f in files) and not any(place in f for f in files for place in raw)


def test_a_load_of_one_month_reads_no_other(spark, tmp_path):
    store = LedgerStore(spark, f"{tmp_path}/s")
    books = ledgers(spark, play=[(f"1997-{m:02d}-05", "1", f"N{m}", f"L{m}", 10) for m in range(1, 13)])
    store.replace_range("play", books.play)
    before = {month: load for load, month in store._pieces()["play"]}
    # Nothing but the month that is loaded is left to read.
    for table in ("play", "play_rollup"):
        for month in before:
            if month != "1997-03":
                shutil.move(f"{store.root}/{table}/load={before[month]}/ledger_month={month}", f"{tmp_path}/{table}{month}")
    store.replace_range("play", ledgers(spark, play=[("1997-03-09", "1", "Z", "L", 1)]).play)
    for table in ("play", "play_rollup"):
        for month in before:
            if month != "1997-03":
                shutil.move(f"{tmp_path}/{table}{month}", f"{store.root}/{table}/load={before[month]}/ledger_month={month}")
    facts = Facts(store.ledgers())
    assert [r.slot_name for r in facts.history("slot_name").collect()] == ["Z"]
    assert facts.clients("slot_days", "coin_in").first()[1:] == (13, 121)


def test_undated_pieces_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("floorledger.sinks.store.UNDATED_PIECES", 3)
    store = LedgerStore(spark, f"{tmp_path}/s")
    for n in range(5):
        store.replace_range("points", points(spark, [(None, f"u{n}")]))
    assert [name for _, name in pairs(store.ledger("points"))] == [f"u{n}" for n in range(5)]
    assert len(store._pieces()["points"]) <= 3


def test_superseded_loads_can_be_deleted(spark, tmp_path):
    store = LedgerStore(spark, f"{tmp_path}/s")
    for tag in "abc":
        store.replace_range("points", points(spark, [("1997-03-05", tag)]))
    assert store.superseded().count() == 2 and store.clean_up() == 2
    assert pairs(store.ledger("points")) == [("1997-03-05", "c")] and store.load_log().count() == 3


def test_a_month_report_on_a_store_reads_that_month_of_play(spark, tmp_path):
    books = ledgers(
        spark,
        play=[(f"1997-{m:02d}-05", "1", f"N{m}", f"L{m}", 10) for m in range(1, 13)],
        comps=[("1997-03-05", "1", " ", 5, "5")],
        points=[("1997-03-05", "1", "N", 1)],
    )
    store = LedgerStore(spark, f"{tmp_path}/s")
    for name in ("play", "comps", "points"):
        store.replace_range(name, books[name])
    report = comps.comps_by_player(Facts(store.ledgers(), "1997", "03"))
    assert [(r.nombre_cliente, r.player_level, r.total_coin_in) for r in report.collect()] == [("N9", "L3", 1010.0)]
    plan = report._jdf.queryExecution().sparkPlan().toString().splitlines()
    assert not any("gaming_date" in line and "player_id" in line for line in plan if "FileScan" in line)
    measured = [line for line in plan if "FileScan" in line and "coin_in_whole" in line]
    assert measured and all("ledger_month" in line and "= 1997-03" in line for line in measured)
    months = options.filter_months(store.ledgers())
    assert [r.mes for r in months.collect()] == [f"{m:02d}" for m in range(1, 13)]
    scans = [line for line in months._jdf.queryExecution().sparkPlan().toString().splitlines() if "FileScan" in line]
    assert all("ReadSchema: struct<>" in line for line in scans)


def test_sections_from_an_iterator_and_no_stale_rows(spark, tmp_path):
    facts = Facts(star_ledgers(spark, "/root/testdata/sf0.001"), "1997", "03")
    assert export_sections(facts, iter(["premios", "cortesias"]), str(tmp_path)) == ["cortesias", "premios"]
    empty = Facts(facts.ledgers.replaced(comps=facts.ledgers.comps.limit(0)), "1997", "03")
    assert export_sections(empty, ["cortesias"], str(tmp_path)) == []
    assert list(exported(spark, str(tmp_path), "1997", "03")) == ["premios"]
    assert exported(spark, str(tmp_path), "1998", "03") == {}
    with pytest.raises(ValueError, match="cortesia"):
        export_sections(facts, ["cortesia"], str(tmp_path))


def test_export(spark, tmp_path):
    facts = Facts(star_ledgers(spark, "/root/testdata/sf0.001"), "1997", "03")
    written = export_sections(facts, list(SECTIONS), str(tmp_path))
    assert written == [name for name in SECTIONS if section_frame(facts, name).count() > 0]
    assert "cortesias" in written and "invitaciones_mdj" not in written
    assert list(exported(spark, str(tmp_path), "1997", "03")) == written
    for name, stored in exported(spark, str(tmp_path), "1997", "03").items():
        expected = section_frame(facts, name)
        assert stored.columns == expected.columns
        assert sorted(map(str, stored.collect())) == sorted(map(str, expected.collect()))


def test_an_export_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    facts = Facts(star_ledgers(spark, "/root/testdata/sf0.001"), "1997", "03")
    names = ["cortesias", "premios", "resumen"]
    export_sections(facts, names, str(tmp_path))
    rows = lambda: {name: sorted(map(str, f.collect())) for name, f in exported(spark, str(tmp_path), "1997", "03").items()}
    before = rows()
    doubled = Facts(facts.ledgers.replaced(comps=facts.ledgers.comps.unionByName(facts.ledgers.comps)), "1997", "03")
    with monkeypatch.context() as patch:
        failing = Section(lambda facts: SECTIONS["premios"].plan(facts).where(F.raise_error(F.lit("disk"))), SECTIONS["resumen"].order)
        patch.setitem(SECTIONS, "resumen", failing)
        with pytest.raises(Exception, match="disk"):
            export_sections(doubled, names, str(tmp_path))
    assert rows() == before
    for _ in range(3):
        export_sections(doubled, names, str(tmp_path))
    assert rows()["cortesias"] != before["cortesias"] and rows()["premios"] == before["premios"]
    # Numbers and sections before the last two are removed.
    folder = tmp_path / "period=1997-Marzo"
    assert len([p for p in (folder / "current").iterdir() if p.name.isdigit()]) == 2
    assert len(list(folder.glob("export=*/section=cortesias"))) == 3  # the failed one was never named


def test_sections_read_a_stored_base_that_is_gone_afterwards(spark):
    facts = Facts(star_ledgers(spark, "/root/testdata/sf0.001"))
    with stored_base(facts) as base:
        for name in ("cortesias", "resumen", "control_invitaciones"):
            files = section_frame(base, name).inputFiles()
            assert any("/clients/" in f for f in files) and any("/vouchers/" in f for f in files)
            assert not any("lineitem" in f for f in files)
        folder = next(f for f in files if "/clients/" in f).removeprefix("file://").split("/clients/")[0]
        assert os.path.isdir(folder)
    assert not os.path.exists(folder)


def test_period_name():
    assert period_name("1997", "03") == "1997-Marzo"
    assert period_name("", None) == "Todos-Todos"
    assert period_name("1997", "99") == "1997-99"
