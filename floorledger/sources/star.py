"""Canonical ledgers as views over the TPC-H-like tables.

The text runs unchanged in Spark SQL and in DuckDB; ``{name}`` is a table or another view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from floorledger.ledgers import Ledgers
from floorledger.operators.lookup import estimated_bytes

# Bytes of a table's files in one partition where it is dealt by a key (see ``StarFrames.deal``).
DEALT_BYTES = 16 * 2**20

TABLES = ("orders", "customer", "lineitem", "part", "supplier")

VIEWS = {
    "play": """
        SELECT CAST(o_orderdate AS DATE) AS gaming_date, CAST(o_custkey AS STRING) AS player_id,
               c_name AS full_name, c_mktsegment AS player_level,
               CASE WHEN o_orderstatus = 'P' THEN CAST(0 AS DOUBLE) ELSE o_totalprice END AS coin_in,
               o_orderkey % 50 AS total_games, CAST(o_orderkey % 90 AS DOUBLE) AS promo_in
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey
        WHERE o_custkey % 7 <> 0 AND o_orderpriority <> '1-URGENT'""",
    "points": """
        SELECT CAST(o_orderdate AS DATE) AS op_date, CAST(o_custkey AS STRING) AS client_id,
               c_name AS client_name, CAST(o_orderkey % 40 AS DOUBLE) AS points,
               CAST((o_orderkey % 40) * 1000 AS DOUBLE) AS coin_in_points
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey
        WHERE o_orderpriority = '1-URGENT'""",
    "comps_raw": """
        SELECT CASE WHEN l_orderkey % 997 = 0 THEN NULL
                    WHEN l_linenumber % 2 = 1 THEN CAST(o_orderdate AS DATE)
                    ELSE CAST(l_shipdate AS DATE) END AS gaming_date,
               CAST(o_custkey AS STRING) AS client_id,
               CASE WHEN o_custkey % 11 = 0 THEN ' ' ELSE c_name END AS client_name,
               p_type AS category, p_brand AS product, l_quantity * 100 AS amount,
               CASE WHEN l_linestatus = 'O' THEN 'QUEMADO' ELSE 'ANULADO' END AS status,
               CONCAT(CAST(l_suppkey AS STRING), '.0') AS user_id, '' AS user_name
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
             JOIN {customer} ON o_custkey = c_custkey JOIN {part} ON l_partkey = p_partkey
        WHERE o_custkey % 5 <> 0""",
    "comps": """
        SELECT gaming_date, client_id, client_name, category, product, amount, status,
               REGEXP_REPLACE(user_id, '[.]0$', '') AS user_id, user_name
        FROM {comps_raw} WHERE status = 'QUEMADO'""",
    "prizes_raw": """
        SELECT CASE WHEN l_linenumber % 2 = 1 THEN o_orderdate ELSE l_shipdate END
                 + (l_partkey % 24) * INTERVAL '1' HOUR AS ts,
               CONCAT('x', CAST(o_custkey AS STRING), 'x') AS client_id, l_extendedprice AS amount,
               CASE l_returnflag WHEN 'R' THEN 'Jackpot HP' WHEN 'A' THEN 'Progressive Jackpot HP'
                                 ELSE 'MDC Purse Clear' END AS pay_type
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "prizes": """
        SELECT CAST(ts - INTERVAL '9' HOUR AS DATE) AS gaming_date,
               TRIM(BOTH 'x' FROM client_id) AS client_id, amount, pay_type
        FROM {prizes_raw} WHERE pay_type IN ('Jackpot HP', 'Progressive Jackpot HP')""",
    "managers": """
        SELECT CAST(s_suppkey AS STRING) AS user_id, s_name AS name,
               CASE WHEN s_suppkey % 5 = 0 THEN 'MDA' WHEN s_suppkey % 5 = 1 THEN 'MDJ'
                    WHEN s_suppkey % 5 = 2 THEN 'AYB' WHEN s_suppkey % 5 = 3 THEN 'HOTEL' ELSE '' END AS area
        FROM {supplier} WHERE s_suppkey % 10 <> 9""",
    "tiers": """
        SELECT * FROM (VALUES ('Primario', CAST(0.10 AS DOUBLE)), ('BUILDING', CAST(0.10 AS DOUBLE)),
          ('MACHINERY', CAST(0.20 AS DOUBLE)), ('HOUSEHOLD', CAST(0.30 AS DOUBLE)),
          ('FURNITURE', CAST(0.05 AS DOUBLE)), ('MDJ', CAST(0.15 AS DOUBLE))) AS t(category, pct)""",
}


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table; its schema is inferred from the file once per process, which costs a job each time."""
    path = f"{directory}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


class StarFrames:
    """Tables and views of a directory by name, each one built when it is first asked for."""

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self.spark, self.directory = spark, directory
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._build(name)
        return self._built[name]

    def deal(self, name: str, key: str) -> None:
        """Deal a table that is about to be joined by a key to partitions of bounded size.

        A sort in the join then takes the same memory at any size.  Left to itself Spark goes by bytes as compressed for the
        shuffle, of which narrow rows with like keys take few, and puts together partitions that are large once sorted.
        """
        rows = self[name]
        parts = max(-(-estimated_bytes(rows) // DEALT_BYTES), int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        self._built[name] = rows.repartition(parts, key)

    def _build(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return table(self.spark, self.directory, name)
        text = VIEWS[name]
        used = {key: self[key] for key in (*TABLES, *VIEWS) if "{" + key + "}" in text}
        return self.spark.sql(text, **used)


def star_ledgers(spark: SparkSession, directory: str) -> Ledgers:
    return Ledgers(StarFrames(spark, directory).__getitem__)
