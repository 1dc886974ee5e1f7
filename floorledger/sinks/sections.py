"""Report export: one dataset per chosen section of a period."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floorledger.functions.days import EVERY, MONTHS
from floorledger.operators.facts import CLIENT_MEASURES, VOUCHER_KEYS, Facts
from floorledger.operators.ordering import ordered
from floorledger.plans import audit, comps, control, prizes, summary
from floorledger.session import scratch_folder
from floorledger.sinks.files import Files


@dataclass(frozen=True)
class Section:
    plan: Callable[[Facts], DataFrame]
    order: Callable[[], list[Column]]
    key: str = "ID"


def _by_amount(column: str) -> Callable[[], list[Column]]:
    return lambda: [F.desc(column), F.col("ID")]


def _by_segment() -> list[Column]:
    return [F.col("segmento"), F.desc("Coin_In"), F.col("client_id")]


# Section names, in export order.
SECTIONS = {
    "cortesias": Section(comps.export_comps, _by_amount("Monto_Cortesias")),
    "premios": Section(prizes.export_prizes, _by_amount("Monto_Premios")),
    "resumen": Section(summary.export_summary, _by_amount("Coin_In")),
    "control_invitaciones": Section(control.export_control, _by_segment, "client_id"),
    "invitaciones_mda": Section(control.export_slots, _by_segment, "client_id"),
    "invitaciones_mdj": Section(control.export_tables, _by_segment, "client_id"),
    "auditoria_coinin_cero": Section(audit.export_audit, lambda: [F.desc("Jornada"), F.col("ID")]),
}
ORDER_ONLY = ("segmento", "client_id")


def section_frame(facts: Facts, name: str) -> DataFrame:
    """A section as it is written: ordered, without the columns that only order it."""
    return _in_order(SECTIONS[name], SECTIONS[name].plan(facts))


def _in_order(section: Section, rows: DataFrame) -> DataFrame:
    return ordered(rows, section.key, *section.order()).drop(*ORDER_ONLY)


def period_name(anio: str | None, mes: str | None) -> str:
    """``1997-Marzo``, ``Todos-Todos``; a text that is no month passes through."""
    names = {f"{i:02d}": name for i, name in enumerate(MONTHS, 1)}
    return f"{anio or EVERY}-{names.get(mes, mes) if mes else EVERY}"


def export_sections(facts: Facts, names: Iterable[str], root: str) -> list[str]:
    """Write the chosen sections of a period, then make them current all at once; returns those that have rows.

    Layout: ``root/period=<label>/export=<id>/section=<name>`` and ``root/period=<label>/current/<number>``, a small file that
    names the export of each section; ``exported`` reads by it.  An export that fails changes nothing.  Sections
    that were not chosen stay as they are, and a chosen section without rows is no longer there.

    Six of the seven sections come from two shared aggregates (activity per client, voucher groups), which are written
    once to the shared scratch folder, so each ledger is scanned once for them, and a lost executor costs no more than
    its running tasks.
    """
    wanted = set(names)
    unknown = sorted(wanted - set(SECTIONS))
    if unknown:
        raise ValueError(f"no such section: {', '.join(unknown)}")
    chosen = [name for name in SECTIONS if name in wanted]
    spark, folder, export = facts.rows["comps"].sparkSession, _folder(root, facts.anio, facts.mes), uuid.uuid4().hex
    written = []
    with stored_base(facts) as base:
        for name in chosen:
            target = f"{folder}/export={export}/section={name}"
            section_frame(base, name).write.parquet(target)
            if not spark.read.parquet(target).isEmpty():
                written.append(name)
    _make_current(Files(spark), folder, export, chosen, written)
    return written


def exported(spark: SparkSession, root: str, anio: str | None = "", mes: str | None = "") -> dict[str, DataFrame]:
    """The current sections of a period, in export order."""
    folder = _folder(root, anio, mes)
    _, current = _current(Files(spark), folder)
    return {
        name: spark.read.parquet(f"{folder}/export={current[name]}/section={name}") for name in SECTIONS if name in current
    }


@contextmanager
def stored_base(facts: Facts) -> Iterator[Facts]:
    """Facts whose per-client activity and voucher groups are written once, and removed after use."""
    clients, vouchers = facts.clients(*CLIENT_MEASURES), facts.vouchers(*VOUCHER_KEYS)
    spark = clients.sparkSession
    folder = scratch_folder(spark)
    try:
        for name, frame in (("clients", clients), ("vouchers", vouchers)):
            frame.write.parquet(f"{folder}/{name}")
        read = lambda name, frame: spark.read.schema(frame.schema).parquet(f"{folder}/{name}")
        yield facts.resting_on(read("clients", clients), read("vouchers", vouchers))
    finally:
        Files(spark).delete(folder)


def _folder(root: str, anio: str | None, mes: str | None) -> str:
    return f"{root}/period={period_name(anio, mes)}"


def _numbers(files: Files, folder: str) -> list[int]:
    return sorted(int(entry.name) for entry in files.entries(f"{folder}/current") if entry.name.isdigit())


def _at(folder: str, number: int) -> str:
    return f"{folder}/current/{number:012d}"


def _current(files: Files, folder: str) -> tuple[int, dict[str, str]]:
    """The newest number, and the export of each section."""
    number = max(_numbers(files, folder), default=0)
    return number, json.loads(files.read(_at(folder, number))) if number else {}


def _make_current(files: Files, folder: str, export: str, chosen: list[str], written: list[str]) -> None:
    """Publish an export's sections; what only numbers before the last one named is removed."""
    while True:
        number, before = _current(files, folder)
        new = {name: of for name, of in before.items() if name not in chosen} | dict.fromkeys(written, export)
        if files.create_new(_at(folder, number + 1), json.dumps(new)):
            break
    kept = {*before.items(), *new.items()}
    for old in _numbers(files, folder):
        if old < number:
            for name, of in set(json.loads(files.read(_at(folder, old))).items()) - kept:
                files.delete(f"{folder}/export={of}/section={name}")
            files.delete(_at(folder, old))


def json_rows(df: DataFrame) -> DataFrame:
    """Each row of a report as one JSON object, for ``write.text`` or a caller that serves it."""
    return df.select(F.to_json(F.struct("*")).alias("fila"))
