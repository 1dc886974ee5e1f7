"""Session for local runs, tests and the benchmark; on a cluster pass your own session instead."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(
    cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g", more: dict[str, str] | None = None
) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("floorledger")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in (more or {}).items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that all executors share, under ``spark.checkpoint.dir``.

    Only where the session names no such folder and runs on one machine, as in tests, a local temporary one is set.
    """
    context = spark.sparkContext
    root = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("on a cluster, spark.checkpoint.dir has to name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="floorledger-")
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/floorledger-{uuid.uuid4().hex}"
