"""Edge rows, and properties that hold on any data."""

from collections import Counter
from datetime import date

import pytest
from pyspark.sql import functions as F

from floorledger.operators.facts import Facts
from floorledger.plans import audit, comps, control, prizes, summary
from floorledger.sinks.sections import section_frame
from floorledger.sources.star import star_ledgers
from tests.rows import dicts, ledgers

TIERS = [("Primario", 0.1), ("GOLD", 0.2), ("MDJ", 0.15)]


@pytest.fixture(scope="module")
def star(spark):
    return star_ledgers(spark, "/root/testdata/sf0.001")


def test_two_names_one_client(spark):
    books = ledgers(
        spark,
        play=[("1997-03-01", "1", "Ana", "GOLD", 100)],
        comps=[("1997-03-01", "1", n, 10, "u") for n in ("A", "a", " ", None)],
    )
    found = {r["nombre_cliente"]: r for r in dicts(comps.comps_by_player(Facts(books)))}
    assert set(found) == {"A", "a", "Ana"}
    assert all(r["total_coin_in"] == 100.0 for r in found.values())
    assert (found["Ana"]["total_cortesias"], found["Ana"]["pct_cortesia_coin_in"]) == (2, 20.0)


def test_names_come_from_all_of_play(spark):
    books = ledgers(
        spark, play=[("1996-01-01", "1", "Ana", "GOLD", 100)], comps=[("1997-03-01", "1", None, 10, "u")]
    )
    row = dicts(comps.comps_by_player(Facts(books, "1997", "03")))[0]
    assert (row["nombre_cliente"], row["total_coin_in"], row["player_level"]) == ("Ana", 0.0, "-")


def test_audit_keeps_undated_and_idle_vouchers(spark):
    books = ledgers(
        spark,
        play=[("1997-03-01", "1", "Ana", "GOLD", 5), ("1997-03-02", "1", "Ana", "GOLD", 0), ("1997-03-03", "1", "Ana", "GOLD", -4)],
        points=[("1997-03-04", "1", "Ana", 1), ("1997-03-05", "1", "Ana", 0), (None, "1", "Ana", 9)],
        comps=[(d, "1", "Ana", 1, u) for d in ("1997-03-01", "1997-03-02", "1997-03-03", "1997-03-04", "1997-03-05", None) for u in ("9", "10")],
        prizes=[("1997-03-02", "1", 7)],
        managers=[("9", "Nueve", "MDA"), ("10", "Diez", "")],
    )
    found = {r["jornada"]: r for r in dicts(audit.audit_zero_play(Facts(books)))}
    assert set(found) == {date(1997, 3, 2), date(1997, 3, 3), date(1997, 3, 5), None}
    assert found[date(1997, 3, 3)]["coin_in"] == -4.0
    second = found[date(1997, 3, 2)]
    assert (second["cant_cortesias"], second["cant_premios"], second["monto_premios"]) == (2, 1, 7.0)
    assert (second["jefe_nombre"], second["jefe_area"]) == ("Diez", "")  # smallest id as text
    assert audit.zero_play_vouchers(Facts(books)).count() == 8
    assert section_frame(Facts(books), "auditoria_coinin_cero").count() == 8
    assert audit.audit_zero_play(Facts(books, "1997", "03")).count() == 3


def test_control_segments_and_allowance(spark):
    books = ledgers(
        spark,
        play=[("1997-03-01", "1", "Ana", "GOLD", 1000), ("1997-03-02", "2", "Bea", None, 50)],
        points=[("1997-03-02", "1", "Ana", 1), ("1997-03-03", "3", "Zoe", 2)],
        comps=[("1997-03-01", c, "x", 5.5, u) for c, u in [("1", "u1"), ("1", "u2"), ("2", None), ("3", "u1")]],
        managers=[("u1", "N1", "MDA"), ("u2", "N2", "MDJ")],
        tiers=TIERS,
    )
    rows = dicts(control.control_all(Facts(books)))
    assert [r["nombre"] for r in rows] == ["Ana", "Bea", "Zoe"]
    ana, bea, zoe = rows
    assert (ana["coin_in_mensual"], ana["dias_asistidos"], ana["pct_asistencia"]) == (2000.0, 2, 66.7)
    assert (ana["invitacion_mensual"], ana["saldo"], ana["total_cortesias"]) == (40, 29, 2)
    assert (bea["nivel"], bea["pct_cat"], bea["saldo"]) == ("", 0.0, -6)  # -5.5 to the even side
    assert (zoe["nivel"], zoe["invitacion_mensual"]) == ("MDJ", 30)
    assert [r["nombre"] for r in dicts(control.control_all(Facts(books), "MDJ"))] == ["Ana"]
    exported = dicts(section_frame(Facts(books), "control_invitaciones"))
    assert [(r["Nombre"], r["Autorizo"], r["Coin_In"]) for r in exported if r["Nombre"] == "Ana"].__len__() == 2
    assert {r["Coin_In"] for r in exported if r["Nombre"] == "Ana"} == {2000.0}
    assert [r["nombre"] for r in dicts(control.control_tables(Facts(books), jefe="u1"))] == ["Zoe", "Ana"]
    assert dicts(control.control_tables(Facts(books), jefe="u1"))[1]["nivel"] == "GOLD"


def test_attendance_tie_goes_to_even(spark):
    play = [(f"1997-03-{d:02d}", "2", "B", "GOLD", 1) for d in range(1, 17)] + [("1997-03-01", "1", "A", "GOLD", 1)]
    books = ledgers(spark, play=play, comps=[("1997-03-01", "1", "A", 1, "u")], tiers=TIERS)
    assert dicts(control.control_all(Facts(books)))[0]["pct_asistencia"] == 6.2


def test_empty_ledgers(spark):
    books = ledgers(spark)
    assert dicts(control.control_kpis(Facts(books)))[0] == {
        "total_cortesias_periodo": 0.0, "total_coin_in_periodo": 0.0, "pct_cortesias_coin_in": 0.0,
        "dias_totales": 1, "pct_primario": 0.0,
    }
    totals = dicts(comps.comps_totals(Facts(books)))[0]
    assert (totals["total_cortesias"], totals["monto_total"], totals["pct_cortesias_coin_in"]) == (0, None, 0.0)
    assert dicts(summary.summary_kpis(Facts(books)))[0]["pct_total"] == 0.0
    assert prizes.prizes_by_player(Facts(books)).count() == 0


def test_products_of_a_large_category_are_rows_dearest_first(spark):
    books = ledgers(spark, comps=[("1997-03-01", "1", "A", 1, "5")])
    wide = books.comps.drop("product", "amount").crossJoin(spark.range(3000).withColumnRenamed("id", "p")).select(
        "*", F.concat(F.lit("P"), F.col("p").cast("string")).alias("product"), (F.col("p") % 700).cast("double").alias("amount")
    )
    rows = dicts(comps.comps_products_nested(Facts(books.replaced(comps=wide.drop("p")))))
    assert len(rows) == 3000
    order = [(-r["monto_total"], r["descripcion_prod"]) for r in rows]
    assert order == sorted(order)


def test_order_of_reports_with_ties(spark):
    books = ledgers(
        spark,
        play=[("1997-03-01", str(n), f"N{n}", "GOLD", 100) for n in range(6)],
        comps=[("1997-03-02", str(n), f"N{n}", 5, "5") for n in (3, 1, 2)],
        prizes=[("1997-03-01", str(n), 7) for n in (5, 4, 3)],
        managers=[("5", "M", "MDA")],
        tiers=[("Primario", 0.1), ("GOLD", 0.2)],
    )
    facts = Facts(books)
    assert [r["cliente_id"] for r in dicts(comps.comps_by_player(facts))] == ["1", "2", "3"]
    assert [r["cliente_id"] for r in dicts(prizes.prizes_by_player(facts))] == ["3", "4", "5"]
    assert [r["player_id"] for r in dicts(summary.summary_players(facts))] == ["1", "2", "3", "4", "5"]
    assert [r["nombre"] for r in dicts(control.control_all(facts))] == ["N1", "N2", "N3"]
    assert [r["cliente_id"] for r in dicts(audit.audit_zero_play(facts))] == ["1", "2", "3"]
    assert [r["ID"] for r in dicts(section_frame(facts, "cortesias"))] == ["1", "2", "3"]


def scans(frame, directory="orders"):
    """Scans of a file in the plan as first laid out."""
    plan = frame._jdf.queryExecution().sparkPlan().toString()
    return sum("FileScan" in line and f"/{directory}.parquet" in line for line in plan.splitlines())


def test_totals_scan_each_ledger_once(spark, star):
    # orders stands behind play and points, and once behind vouchers
    assert scans(control.control_kpis(Facts(star))) == 3
    assert scans(control.control_slots_kpis(Facts(star))) == 2


def test_audit_sorts_no_raw_vouchers(spark, star):
    """Below the first exchange over vouchers, aggregates are hashed."""
    plan = audit._zero_play(Facts(star), audit.KEYS)._jdf.queryExecution().sparkPlan().toString().splitlines()
    sorts = [n for n, line in enumerate(plan) if "SortAggregate" in line]
    vouchers = [n for n, line in enumerate(plan) if "HashAggregate(keys=[client_id" in line and "user_id" in line]
    assert vouchers and all(n < max(vouchers) for n in sorts if "client_name" in plan[n])


def test_categories_add_up(star):
    facts = Facts(star)
    whole = dicts(comps.comps_totals(facts))[0]
    categories = dicts(comps.comps_by_category(facts))
    assert sum(r["cantidad"] for r in categories) == whole["total_cortesias"]
    assert sum(r["monto_total"] for r in categories) == pytest.approx(whole["monto_total"])
    shares = Counter()
    for row in dicts(comps.comps_by_product(facts)):
        shares[row["descripcion_cat"]] += row["pct_categoria"]
    assert all(share == pytest.approx(100.0) for share in shares.values())


def test_idle_and_active_vouchers_partition_the_ledger(star):
    facts = Facts(star)
    idle = audit.zero_play_vouchers(facts)
    active = facts.rows["comps"].join(audit._active_days(facts), audit.KEYS, "left_semi")
    assert idle.count() == 1488
    assert idle.count() + active.count() == star.comps.count()


def test_segments_share_no_client(star):
    rows = control.control_rows(Facts(star)).select("client_id", "segmento").collect()
    assert len({r.client_id for r in rows}) == len(rows)


def test_report_sizes_at_two_scales(spark, star):
    assert control.control_all(Facts(star)).count() == 118
    assert control.control_all(Facts(star, "1997", "03")).count() == 6
    assert audit.audit_zero_play(Facts(star)).count() == 1281
    larger = star_ledgers(spark, "/root/testdata/sf0.01")
    assert control.control_all(Facts(larger)).count() == 1177
    assert control.control_all(Facts(larger, "1997", "03")).count() == 83
    assert audit.audit_zero_play(Facts(larger)).count() == 13033


def test_no_report_needs_a_single_task_window(spark, star):
    facts = Facts(star)
    for report in (comps.comps_by_category, comps.comps_by_product, prizes.prizes_by_type, control.control_chart):
        assert "Window" not in report(facts)._jdf.queryExecution().executedPlan().toString()


def test_clients_are_read_once(spark, star):
    want = ("slot_rows", "slot_name", "player_level", "coin_in", "any_days", "table_name", "table_coin", "prize_amount")
    frame = Facts(star).clients(*want)
    assert scans(frame) == 3  # play, points, and below prizes
    assert scans(frame, "lineitem") == 1
