"""Headline queries and the stored path, one warm-up and the median of several runs; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3),
BENCH_ALL=1 times every named query.  BENCH_TARGET names the folder that stores and exports go to; without it they go
to the session's shared scratch folder.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorledger.catalogue import BATCH, MONTH, QUERIES, YEAR
from floorledger.operators.facts import Facts
from floorledger.plans import audit, comps
from floorledger.session import local_session, scratch_folder
from floorledger.sinks.loading import load_feeds
from floorledger.sinks.sections import SECTIONS, export_sections, section_frame
from floorledger.sinks.store import LedgerStore
from floorledger.sources.feeds import FEEDS
from floorledger.sources.raw_star import raw_feed
from floorledger.sources.star import star_ledgers

HEADLINE = (
    "audit_zero_play", "control_all", "control_all_month", "control_tables", "summary_players", "comps_by_player",
    "comps_by_product", "prizes_by_player", "audit_chart_by_area", "backfill_names", "replace_range", "clean_comps",
)


def run_all(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def export_apart(facts: Facts, target: str) -> None:
    for name in SECTIONS:
        section_frame(facts, name).write.mode("overwrite").parquet(f"{target}/{name}")


def write_feeds(spark: SparkSession, directory: str, target: str) -> dict[str, str]:
    """The raw feeds as delimited text with their title rows, as they would land."""
    paths = {}
    for feed, layout in FEEDS.items():
        paths[feed] = f"{target}/feeds/{feed}.csv"
        titles = spark.range(layout.skip).select(
            *[F.lit(None).cast("string").alias(f"_c{n}") if n else F.concat(F.lit("t"), "id").alias("_c0") for n in range(layout.width)]
        )
        rows = titles.coalesce(1).unionByName(raw_feed(spark, directory, feed)).coalesce(1)
        rows.write.mode("overwrite").csv(paths[feed], emptyValue="", nullValue="")
    return paths


def median_of(action: Callable[[], None], runs: int) -> float:
    action()
    times = []
    for _ in range(runs):
        start = time.perf_counter()
        action()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times), 3)


def stored_path(spark: SparkSession, directory: str, target: str) -> dict[str, Callable[[], object]]:
    """What runs in production: feeds to a store, a month replaced, month reports and the export from the store."""
    feeds = write_feeds(spark, directory, target)
    store = LedgerStore(spark, f"{target}/store")

    def batch() -> DataFrame:
        rows = store.ledger("comps").drop("ledger_month")
        return rows.where(F.col("gaming_date").between(F.lit(BATCH[0]), F.lit(BATCH[1])))

    return {
        "store_load_feeds": lambda: load_feeds(store, feeds),
        "store_replace_month": lambda: store.replace_range("comps", batch()),
        "store_comps_by_player_month": lambda: run_all(comps.comps_by_player(Facts(store.ledgers(), YEAR, MONTH))),
        "store_audit_zero_play_month": lambda: run_all(audit.audit_zero_play(Facts(store.ledgers(), YEAR, MONTH))),
        "store_export_month": lambda: export_sections(Facts(store.ledgers(), YEAR, MONTH), SECTIONS, f"{target}/export"),
    }


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores, shuffle_partitions=int(cores), memory="12g")
    target = os.environ.get("BENCH_TARGET") or scratch_folder(spark)
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    facts = Facts(star_ledgers(spark, directory))
    actions: dict[str, Callable[[], object]] = {
        name: lambda n=name: run_all(QUERIES[n](spark, directory)) for name in names
    }
    actions["export_seven_sections"] = lambda: export_sections(facts, SECTIONS, f"{target}/shared")
    actions["export_seven_sections_apart"] = lambda: export_apart(facts, f"{target}/apart")
    actions |= stored_path(spark, directory, target)
    times = {name: median_of(action, runs) for name, action in actions.items()}
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": directory.rstrip("/").rsplit("sf", 1)[-1],
                "config": {"cores": cores, "runs": runs, "shuffle_partitions": cores, "driver_memory": "12g"},
            }
        )
    )


if __name__ == "__main__":
    main()
