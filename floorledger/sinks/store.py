"""Stored ledgers: month partitions, range-replace loads, and the load log.

Layout under the store's root::

    <ledger>/load=<id>/ledger_month=<yyyy-MM|undated>/part-*.parquet
    <ledger>_rollup/load=<id>/ledger_month=<...>/part-*.parquet     the same rows added up per client
    <dimension>/load=<id>/part-*.parquet
    history/load=<id>/part-*.parquet     older entries of the load log
    log/<number>                         what is current, and the latest entries of the load log

A load writes its files under a fresh ``load=<id>`` and then creates ``log/<number>`` with the next number: all pieces
(table, load, month) that are current from then on.  That one small file publishes it: readers take the pieces from the
newest number, so a failed or repeated job changes nothing and a reader never sees half a batch.  The file can be
created once only; of two writers the later one finds the number taken and works out its change again, from what
the earlier one published.  A read lists a bounded number of names and opens one file, however many loads there were:
old numbers are removed, and the load log is moved to ``history`` now and then.

A load of a ledger rewrites only the first and the last month of its day range (to keep the stored days outside
the range); months between are superseded without being read, and other months are not touched.  Undated rows only
accumulate; their pieces are put together when there are many.  Months and bounds are compared as Spark writes
them, so that a mistyped year below 1000 sorts where it belongs.  Beside each piece of play, points and prizes lies
its rollup, made from that piece alone, so a load costs what its own months cost.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import cached_property

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floorledger.ledgers import DAY_COLUMN, KEY_COLUMN, MONTH_COLUMN, SCHEMAS, UNDATED, Ledgers
from floorledger.operators.activity import ROLLUPS, rollup
from floorledger.sinks.files import Files

ENTRY = "table_name STRING, file_name STRING, source STRING, rows BIGINT, loaded_at TIMESTAMP, load STRING, number BIGINT"

# Pieces of undated rows from which they are written as one.
UNDATED_PIECES = 20
# Entries of the load log from which they are moved to the history, and numbers that stay for readers under way.
RECENT_LOADS, KEPT_NUMBERS = 100, 20
# Age from which a folder that no load has published is taken for the rest of a failed one.
ABANDONED = timedelta(days=2)

# A piece: load id and month, which is null for a table without months.
Piece = tuple[str, str | None]


class DuplicateKeys(ValueError):
    """A dimension that names a key twice."""


@dataclass
class State:
    """What is current: the pieces of every table, the latest entries of the load log, and where older ones are."""

    number: int
    pieces: dict[str, list[Piece]]
    recent: list[dict]
    history: str | None

    @staticmethod
    def parsed(number: int, text: str) -> State:
        read = json.loads(text)
        pieces = {table: [tuple(piece) for piece in own] for table, own in read["pieces"].items()}
        return State(number, pieces, read["recent"], read["history"])

    def text(self) -> str:
        return json.dumps({"pieces": self.pieces, "recent": self.recent, "history": self.history})


@dataclass
class LedgerStore:
    spark: SparkSession
    root: str

    # ---- reading ----------------------------------------------------------------------------------

    @cached_property
    def _files(self) -> Files:
        return Files(self.spark)

    def _numbers(self) -> list[int]:
        names = [entry.name for entry in self._files.entries(f"{self.root}/log")]
        return sorted(int(name) for name in names if re.fullmatch("[0-9]+", name))

    def _log_file(self, number: int) -> str:
        return f"{self.root}/log/{number:012d}"

    def _newest(self) -> int:
        """Number of the last finished load, 0 before the first."""
        return max(self._numbers(), default=0)

    def _state(self) -> State:
        number = self._newest()
        while number:
            try:
                return State.parsed(number, self._files.read(self._log_file(number)))
            except Py4JJavaError:
                # Removed meanwhile, if many loads were published since it was listed.
                if self._newest() == number:
                    raise
                number = self._newest()
        return State(0, {}, [], None)

    def _pieces(self) -> dict[str, list[Piece]]:
        """Current pieces of every table: at most a few per month of operation."""
        return self._state().pieces

    def _read(self, table: str, schema: str, pieces: list[Piece]) -> DataFrame:
        schema = f"{schema}, {MONTH_COLUMN} STRING"
        if not pieces:
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/{table}"
        paths = [f"{base}/load={load}/{MONTH_COLUMN}={month}" for load, month in pieces]
        # The load id is given as text: an all-digit one must not be taken for a number.
        stored = self.spark.read.schema(f"{schema}, load STRING").option("basePath", base).parquet(*paths)
        return stored.drop("load")

    def _ledger(self, table: str, state: State) -> DataFrame:
        return self._read(table, SCHEMAS[table], state.pieces.get(table, []))

    def _rollup(self, table: str, state: State) -> DataFrame | None:
        return self._read(f"{table}_rollup", ROLLUPS[table], state.pieces.get(table, [])) if table in ROLLUPS else None

    def _dimension(self, table: str, state: State) -> DataFrame:
        pieces = state.pieces.get(table)
        if not pieces:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.root}/{table}/load={pieces[0][0]}")

    def ledger(self, table: str) -> DataFrame:
        """Current rows; the month column prunes partitions when a period filter is applied."""
        return self._ledger(table, self._state())

    def rollup(self, table: str) -> DataFrame | None:
        """What the current rows add up to per client and month; None for a ledger that keeps none."""
        return self._rollup(table, self._state())

    def dimension(self, table: str) -> DataFrame:
        return self._dimension(table, self._state())

    def ledgers(self) -> Ledgers:
        """All tables as of now: a load that is published later does not show in them."""
        state = self._state()
        read = lambda name: (self._ledger if name in DAY_COLUMN else self._dimension)(name, state)
        return Ledgers(read, lambda name: self._rollup(name, state))

    def _entries(self, state: State) -> DataFrame:
        """Entries of the load log: the latest from the state, the others from one folder."""
        rows = [
            {**entry, "loaded_at": datetime.fromisoformat(entry["loaded_at"])} for entry in state.recent
        ]
        recent = self.spark.createDataFrame(rows, ENTRY)
        if not state.history:
            return recent
        return recent.unionByName(self.spark.read.schema(ENTRY).parquet(f"{self.root}/history/load={state.history}"))

    def load_log(self) -> DataFrame:
        """Load history, newest first."""
        log = self._entries(self._state()).orderBy(F.desc("loaded_at"), F.desc("number"))
        return log.select("table_name", "file_name", "rows", "loaded_at")

    def has_loaded(self, table: str, source: str) -> bool:
        """Whether a delivery of that name has been loaded into the table."""
        return self._has_loaded(self._state(), table, source)

    def _has_loaded(self, state: State, table: str, source: str) -> bool:
        if any((entry["table_name"], entry["source"]) == (table, source) for entry in state.recent):
            return True
        if not state.history:
            return False
        return not self._entries(state).where((F.col("table_name") == table) & (F.col("source") == source)).isEmpty()

    # ---- writing ----------------------------------------------------------------------------------

    def _publish(
        self, table: str, file_name: str, source: str | None, rows: int, load: str,
        change: Callable[[list[Piece]], list[Piece]],
    ) -> bool:
        """Make a change of a table's pieces current; False where another writer has loaded the same source meanwhile.

        The change is worked out from the current pieces, again whenever another writer has changed them.
        """
        seen, pieces = None, []
        while True:
            state = self._state()
            if source is not None and self._has_loaded(state, table, source):
                return False
            live = state.pieces.get(table, [])
            if live != seen:
                seen, pieces = live, change(live)
            number = state.number + 1
            entry = {
                "table_name": table, "file_name": file_name, "source": source, "rows": rows,
                "loaded_at": datetime.now(timezone.utc).isoformat(), "load": load, "number": number,
            }
            recent, history = [*state.recent, entry], state.history
            if len(recent) > RECENT_LOADS:
                recent, history = [entry], self._moved(state)
            new = State(number, {**state.pieces, table: pieces}, recent, history)
            if self._files.create_new(self._log_file(number), new.text()):
                for old in self._numbers():
                    if old <= number - KEPT_NUMBERS:
                        self._files.delete(self._log_file(old))
                return True

    def _moved(self, state: State) -> str:
        """All entries of a state in a new folder of the history."""
        folder = uuid.uuid4().hex
        self._entries(state).coalesce(1).write.parquet(f"{self.root}/history/load={folder}")
        return folder

    def replace_range(self, table: str, batch: DataFrame, file_name: str = "", source: str | None = None) -> int:
        """Replace the stored days that a cleaned batch spans by the batch; returns its row count.

        A batch of a ``source`` that has been loaded is left out, and counts 0: before anything is written, or, where
        another writer loads it meanwhile, before it is published.
        """
        if source is not None and self.has_loaded(table, source):
            return 0
        day, load = DAY_COLUMN[table], uuid.uuid4().hex
        self._write_pieces(table, batch, load)

        # The batch is cleaned once; its bounds and months come from the written files, as text.
        low, high = F.min(day), F.max(day)
        bounds = self._written(table, load).agg(
            F.count(F.lit(1)).alias("rows"),
            *[text.cast("string").alias(name) for name, text in (("low", low), ("high", high))],
            *[F.date_format(text, "yyyy-MM").alias(name) for name, text in (("first", low), ("last", high))],
        ).first()
        own = self._written_pieces(table, load)

        def change(live: list[Piece]) -> list[Piece]:
            """The batch, what the months at its edges hold outside its days, and the months that it does not reach."""
            gone, kept = [], []
            if bounds.low is not None:
                gone += [piece for piece in live if piece[1] != UNDATED and bounds.first <= piece[1] <= bounds.last]
                edges = [piece for piece in live if piece[1] in (bounds.first, bounds.last)]
                outside = (F.col(day) < F.lit(bounds.low).cast("date")) | (F.col(day) > F.lit(bounds.high).cast("date"))
                kept += self._rewritten(table, edges, outside)
            undated = [piece for piece in live if piece[1] == UNDATED]
            if len(undated) >= UNDATED_PIECES:
                gone += undated
                kept += self._rewritten(table, undated, F.lit(True))
            return [piece for piece in live if piece not in gone] + own + kept

        return bounds.rows if self._publish(table, file_name, source, bounds.rows, load, change) else 0

    def _rewritten(self, table: str, pieces: list[Piece], kept: Column) -> list[Piece]:
        """New pieces with some rows of the given ones."""
        if not pieces:
            return []
        load = uuid.uuid4().hex
        rows = self._read(table, SCHEMAS[table], pieces).drop(MONTH_COLUMN)
        self._write_pieces(table, rows.where(kept), load)
        return self._written_pieces(table, load)

    def _write_pieces(self, table: str, rows: DataFrame, load: str) -> None:
        """The rows by month, then their rollup from what was written."""
        self._write_months(rows, DAY_COLUMN[table], f"{self.root}/{table}/load={load}")
        if table in ROLLUPS:
            sums = rollup(self._written(table, load), table, MONTH_COLUMN).hint("rebalance", MONTH_COLUMN)
            sums.write.partitionBy(MONTH_COLUMN).parquet(f"{self.root}/{table}_rollup/load={load}")

    def _written(self, table: str, load: str) -> DataFrame:
        return self.spark.read.schema(f"{SCHEMAS[table]}, {MONTH_COLUMN} STRING").parquet(f"{self.root}/{table}/load={load}")

    def _written_pieces(self, table: str, load: str) -> list[Piece]:
        names = [entry.name for entry in self._files.entries(f"{self.root}/{table}/load={load}")]
        start = f"{MONTH_COLUMN}="
        return [(load, name.removeprefix(start)) for name in sorted(names) if name.startswith(start)]

    def _write_months(self, rows: DataFrame, day: str, target: str) -> None:
        """One directory per month; rebalancing gives even files whether the rows span a day or years."""
        month = F.coalesce(F.date_format(day, "yyyy-MM"), F.lit(UNDATED))
        balanced = rows.withColumn(MONTH_COLUMN, month).hint("rebalance", MONTH_COLUMN)
        balanced.write.mode("append").partitionBy(MONTH_COLUMN).parquet(target)

    def refresh(self, table: str, rows: DataFrame, file_name: str = "", source: str | None = None) -> int:
        """Replace a whole dimension; refused when a key occurs twice, which would double report rows."""
        load = uuid.uuid4().hex
        target = f"{self.root}/{table}/load={load}"
        rows.write.parquet(target)
        written, key = self.spark.read.schema(SCHEMAS[table]).parquet(target), KEY_COLUMN[table]
        twice = written.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").orderBy(key).limit(20).collect()
        if twice:
            self._files.delete(target)
            raise DuplicateKeys(f"{table}: {key} occurs more than once: {', '.join(row[0] for row in twice)}")
        count = written.count()
        return count if self._publish(table, file_name, source, count, load, lambda live: [(load, None)]) else 0

    # ---- cleaning up ------------------------------------------------------------------------------

    def superseded(self, abandoned: timedelta = ABANDONED) -> DataFrame:
        """``table_name, load`` of folders that can be deleted: no current piece names them, and they were published once
        or have lain unpublished for so long that their load must have failed.

        Found by listing the folders that there are, which are those of the current pieces and of the loads since the last
        ``clean_up``.
        """
        state = self._state()
        current = {(table, load) for table, own in state.pieces.items() for load, _ in own} | {("history", state.history)}
        oldest = datetime.now(timezone.utc) - abandoned
        loose = [
            (table, entry.name.removeprefix("load="), entry.modified <= oldest)
            for table in (*SCHEMAS, "history")
            for entry in self._files.entries(f"{self.root}/{table}")
            if entry.name.startswith("load=") and (table, entry.name.removeprefix("load=")) not in current
        ]
        listed = self.spark.createDataFrame(loose, "table_name STRING, load STRING, old BOOLEAN")
        published = self._entries(state).select("table_name", "load", F.lit(True).alias("published"))
        known = listed.join(published, ["table_name", "load"], "left")
        return known.where(F.col("old") | F.col("published")).select("table_name", "load")

    def clean_up(self, loads: Iterable[tuple[str, str]] | None = None, abandoned: timedelta = ABANDONED) -> int:
        """Delete the folders of superseded loads; call it while no report reads the store.  Returns their number.

        Without a list, all superseded loads go: their names, one per load since the last call, come to the driver.
        """
        chosen = [tuple(row) for row in self.superseded(abandoned).collect()] if loads is None else list(loads)
        gone = 0
        for table, load in chosen:
            if table in ROLLUPS:
                self._files.delete(f"{self.root}/{table}_rollup/load={load}")
            gone += self._files.delete(f"{self.root}/{table}/load={load}")
        return gone
