import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from floorledger.catalogue import QUERIES
from floorledger.operators.activity import client_activity
from floorledger.operators.facts import Facts
from floorledger.operators.filters import authorised_by, period
from floorledger.operators.keyfilter import FILTER_BITS, is_worth_filtering, key_words, possible_rows
from floorledger.operators.lookup import HOT_SHARE, hot_keys, is_broadcast, left_join, lookup_join, semi_join
from floorledger.operators.names import backfill_names
from floorledger.operators.ordering import sort_report
from floorledger.operators.replace import replace_range
from floorledger.plans import audit
from floorledger.sources import star
from floorledger.sources.star import star_ledgers
from tests.rows import day, dicts, ledgers

DAYS = ["1996-12-31", "1997-01-01", "1997-03-15", "1997-12-31", "1998-03-01", None]


@pytest.mark.parametrize(
    ("anio", "mes", "expected"),
    [
        ("", "", DAYS),
        (None, None, DAYS),
        ("1997", "", ["1997-01-01", "1997-03-15", "1997-12-31"]),
        ("1997", "12", ["1997-12-31"]),
        ("", "03", ["1997-03-15", "1998-03-01"]),
        ("97", "", []),
        ("", "3", []),
    ],
)
def test_period(spark, anio, mes, expected):
    frame = spark.createDataFrame([(day(d),) for d in DAYS], "d DATE")
    found = {r.d for r in period(frame, "d", anio, mes).collect()}
    assert found == {day(d) for d in expected}


def test_period_range_reaches_the_scan(spark, tmp_path):
    spark.range(10).select(F.date_add(F.lit(date(1997, 1, 1)), F.col("id").cast("int")).alias("d")).write.parquet(
        f"{tmp_path}/t"
    )
    plan = period(spark.read.parquet(f"{tmp_path}/t"), "d", "1997", "03")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(d,1997-03-01)" in plan and "LessThan(d,1997-04-01)" in plan


def test_manager_wins_over_area(spark):
    books = ledgers(
        spark,
        comps=[("1997-03-01", "1", "A", 1, "u1"), ("1997-03-01", "1", "A", 2, "u2"), ("1997-03-01", "1", "A", 3, None)],
        managers=[("u1", "N1", "MDA"), ("u2", "N2", "MDJ")],
    )
    amounts = lambda **k: sorted(r.amount for r in authorised_by(books.comps, books.managers, **k).collect())
    assert amounts() == [1.0, 2.0, 3.0]
    assert amounts(area="MDA") == [1.0]
    assert amounts(area="MDA", jefe="u2") == [2.0]


def test_hot_keys_are_few(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    assert [r.k for r in hot_keys(rows, ["k"]).collect()] == [7]
    even = spark.range(HOT_SHARE).select((F.col("id") % 500).alias("k"))
    assert hot_keys(even, ["k"]).count() == 500


def test_lookup_join_equals_a_left_join(spark):
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 2500)
    rows = spark.range(20_000).select("id", key.alias("k"), (F.col("id") % 2).alias("h"))
    lookup = spark.range(0, 2500, 2).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("h"), F.hash("id").alias("x"))
    plain = rows.join(lookup, ["k", "h"], "left").select("id", "k", "h", "x")
    safe = lookup_join(rows, lookup, ["k", "h"])
    assert safe.count() == 20_000
    assert sorted(safe.collect(), key=lambda r: r.id) == sorted(plain.collect(), key=lambda r: r.id)


def test_lookup_join_keeps_hot_rows_without_a_match(spark):
    rows = spark.createDataFrame([("a",)] * 50 + [(None,)] * 50, "k STRING")
    lookup = spark.createDataFrame([("b", 1)], "k STRING, x INT")
    assert lookup_join(rows, lookup, ["k"]).where("x is null").count() == 100


def largest_share(frame):
    """Rows of the fullest task against the mean."""
    counts = [r[0] for r in frame.groupBy(F.spark_partition_id()).count().select("count").collect()]
    return max(counts) / (sum(counts) / len(counts))


def test_joins_to_a_large_lookup_spread_a_hot_key(spark):
    rows = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 9000).alias("k"))
    lookup = spark.range(5000).select(F.col("id").alias("k"), F.hash("id").alias("x"))
    small = semi_join(rows, lookup, ["k"])
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString() and is_broadcast(lookup)
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.skewJoin.enabled": "false",
    }
    before = {key: spark.conf.get(key, None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        assert not is_broadcast(lookup)
        semi, left = semi_join(rows, lookup, ["k"]), left_join(rows, lookup, ["k"])
        plain = rows.join(lookup, "k", "left_semi")
        assert largest_share(plain) > 2 and largest_share(semi) < 2 and largest_share(left) < 2
        assert semi.columns == rows.columns
        assert sorted(map(tuple, semi.collect())) == sorted(map(tuple, plain.select("id", "k").collect()))
        assert left.count() == 60_000 and left.where("x is not null").count() == semi.count()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_managers_beyond_a_broadcast(spark):
    books = ledgers(
        spark,
        comps=[("1997-03-01", str(i), "A", i, u) for i, u in enumerate(["u1"] * 50 + ["u2", None] * 20)],
        managers=[("u1", "N1", "MDA"), ("u2", "N2", "MDJ")],
    )
    small = sorted(map(tuple, authorised_by(books.comps, books.managers, area="MDA").collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, authorised_by(books.comps, books.managers, area="MDA").collect())) == small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(small) == 50


def test_only_possible_keys_pass(spark):
    rows = spark.range(50_000).select((F.col("id") % 700).cast("string").alias("c"), F.date_add(F.lit(date(1997, 1, 1)), (F.col("id") % 365).cast("int")).alias("d"), "id")
    wanted = rows.where("id % 1000 = 3").select("c", "d").unionByName(spark.createDataFrame([(None, None)], "c STRING, d DATE"))
    passed = possible_rows(rows, ["c", "d"], key_words(wanted, ["c", "d"]))
    assert passed.columns == rows.columns
    exact = rows.join(wanted.distinct(), ["c", "d"], "left_semi")
    assert exact.join(passed, "id", "left_anti").count() == 0
    assert exact.count() <= passed.count() <= exact.count() + 10
    assert key_words(rows, ["c", "d"]).count() <= FILTER_BITS / 64
    assert not is_worth_filtering(rows, wanted)


def test_the_audit_is_the_same_with_filtered_play(spark, monkeypatch):
    facts = Facts(star_ledgers(spark, "/root/testdata/sf0.001"))
    plans = (audit.audit_zero_play, audit.zero_play_vouchers, audit.audit_chart, audit.export_audit)
    rows = lambda: [sorted(map(str, plan(facts).collect())) for plan in plans]
    days = lambda: audit._day_facts(facts, facts.rows["comps"]).count()
    before, all_days = rows(), days()
    monkeypatch.setattr("floorledger.plans.audit.filtered", lambda frame, keys, wanted: possible_rows(frame, keys, key_words(wanted, keys)))
    assert rows() == before and days() < all_days


def test_activity_counts_days_once(spark):
    books = ledgers(
        spark,
        play=[
            ("1997-03-01", "1", "Ana", "GOLD", 10.25),
            ("1997-03-01", "1", "Añá", "BLACK", 0.10),  # same day under another name
            ("1997-03-31", "1", "Ana", "GOLD", 5),
            ("1997-04-01", "2", None, None, -1),
        ],
        points=[("1997-03-31", "1", "Ana T", 2), ("1997-05-01", "1", "Ana T", 1), (None, "3", "Zoe", 4)],
        prizes=[("1997-03-01", "1", 7), ("1997-03-02", "9", 8)],
    )
    frames = {"play": books.play, "points": books.points, "prizes": books.prizes}
    want = ("slot_rows", "slot_name", "player_level", "coin_in", "table_coin", "slot_days", "table_days", "any_days",
            "prize_rows", "prize_amount")
    found = {r.pop("client_id"): r for r in dicts(client_activity(frames, *want))}
    one = found["1"]
    assert (one["slot_rows"], one["slot_name"], one["player_level"]) == (3, "Añá", "GOLD")
    assert (float(one["coin_in"]), float(one["table_coin"]), float(one["prize_amount"])) == (15.35, 3000.0, 7.0)
    assert (one["slot_days"], one["table_days"], one["any_days"], one["prize_rows"]) == (2, 2, 3, 1)
    assert (found["2"]["slot_rows"], found["2"]["slot_days"], found["2"]["any_days"]) == (1, 1, 1)
    assert (found["3"]["slot_rows"], found["3"]["table_days"], found["3"]["any_days"]) == (0, 0, 0)
    assert (found["9"]["slot_rows"], found["9"]["prize_rows"], found["9"]["coin_in"]) == (0, 1, None)


def test_activity_of_a_hot_client_equals_brute_force(spark):
    client = F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 40).cast("string"))
    start = F.lit(date(1997, 1, 1))
    play = spark.range(6000).select(
        F.date_add(start, (F.col("id") % 97).cast("int")).alias("gaming_date"),
        client.alias("player_id"),
        F.concat(F.lit("N"), (F.col("id") % 5).cast("string")).alias("full_name"),
        F.lit("L").alias("player_level"),
        (F.col("id") % 1000 / 100.0).alias("coin_in"),
        F.col("id").alias("total_games"),
        F.lit(0.0).alias("promo_in"),
    )
    found = {r.client_id: r for r in client_activity({"play": play}, "slot_name", "slot_days", "coin_in").collect()}
    rows = play.collect()
    for name in ("hot", "1", "7"):
        mine = [r for r in rows if r.player_id == name]
        assert found[name].slot_days == len({r.gaming_date for r in mine})
        assert found[name].slot_name == max(r.full_name for r in mine)
        assert float(found[name].coin_in) == round(sum(round(r.coin_in * 100) for r in mine)) / 100


def test_backfill(spark):
    books = ledgers(
        spark,
        play=[("1997-03-01", "1", "Ana", "GOLD", 1), ("1997-03-02", "1", "Bea", "GOLD", 1), ("1997-03-02", "4", " ", "X", 1)],
        comps=[("1997-03-01", c, n, 1, "u") for c, n in [("1", None), ("1", "  "), ("1", "Own"), ("2", ""), ("4", None)]],
    )
    found = sorted((r.client_id, r.client_name) for r in backfill_names(books.comps, books.play).collect())
    none = "(Sin registro en SRW)"
    assert found == [("1", "Bea"), ("1", "Bea"), ("1", "Own"), ("2", none), ("4", none)]


def test_replace_range(spark):
    frame = lambda days, tag: spark.createDataFrame([(day(d), tag) for d in days], "d DATE, tag STRING")
    stored = frame(["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04", "2024-01-05", None], "old")
    batch = frame(["2024-01-02", "2024-01-04"], "new")
    pairs = lambda f: sorted((str(r.d), r.tag) for r in f.collect())
    expected = [("2024-01-01", "old"), ("2024-01-02", "new"), ("2024-01-04", "new"), ("2024-01-05", "old"), ("None", "old")]
    once = replace_range(stored, batch, "d")
    assert pairs(once) == expected
    assert pairs(replace_range(once, batch, "d")) == expected
    undated = frame([None], "new")
    assert len(pairs(replace_range(stored, undated, "d"))) == 7


def test_sort_report(spark):
    names = spark.createDataFrame([("Oa", 1), ("Ñu", 10), ("ábaco", 9), ("Nz", 2)], "nombre STRING, n INT")
    assert [r.nombre for r in sort_report(names, "nombre").collect()] == ["ábaco", "Nz", "Ñu", "Oa"]
    assert [r.n for r in sort_report(names, "n", ascending=False).collect()] == [10, 9, 2, 1]


def test_ids_come_from_joins_dealt_by_size(spark, tmp_path, monkeypatch):
    orders = [(n, n % 12 if n else None) for n in range(40)]
    lines = [(n % 45 if n % 50 else None, n % 7 if n % 11 else None, n % 9 if n % 13 else None) for n in range(200)]
    rows = {
        "customer": ([(n, f"name {n}") for n in (*range(11), None)], "c_custkey BIGINT, c_name STRING"),
        "part": ([(n, "t", "b") for n in (*range(6), None)], "p_partkey BIGINT, p_type STRING, p_brand STRING"),
        "orders": ([(*row, day("1997-03-01")) for row in orders], "o_orderkey BIGINT, o_custkey BIGINT, o_orderdate DATE"),
        "lineitem": (
            [(*row, n % 3, 1.0, 1.0, "R", "O", day("1997-03-02")) for n, row in enumerate(lines)],
            """l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,
               l_extendedprice DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate DATE""",
        ),
    }
    for name, (own, schema) in rows.items():
        frame = spark.createDataFrame(own, schema)
        for column in ("o_orderdate", "l_shipdate"):
            frame = frame.withColumn(column, F.col(column).cast("timestamp")) if column in frame.columns else frame
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    joined = [(owner, part, supplier) for key, part, supplier in lines for order, owner in orders if key == order and key is not None]
    expected = {("prizes", owner is not None and f"x{owner}x" or None) for owner, _, _ in joined} | {
        ("comps", supplier is not None and f"{supplier}.0" or None)
        for owner, part, supplier in joined
        if owner is not None and owner < 11 and owner % 5 and part is not None and part < 6
    }
    monkeypatch.setattr(star, "DEALT_BYTES", 100)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ids = QUERIES["normalize_ids"](spark, str(tmp_path))
        found = [(row.feed, row.raw_id) for row in ids.collect()]
        plan = ids._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert set(found) == expected and len(found) == len(expected)
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(l_orderkey#[0-9]+L, ([0-9]+)\), REPARTITION_BY_NUM", plan)]
    assert dealt and min(dealt) > int(spark.conf.get("spark.sql.shuffle.partitions"))
