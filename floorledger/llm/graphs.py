"""Connected components of an undirected graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorledger.llm.scratch import stored

# Rows of labels from which another task writes them.
LABELS_PER_TASK = 250_000
LEAST_TASKS = 8


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node on a link; the component is its smallest node.

    ``links`` has the columns a and b.  A round gives each node the smallest label among itself and its neighbours,
    then the label of that label, so that labels travel twice as far with each round; it ends when no label has
    changed.  Smallest labels are aggregates, combined before the shuffle, so a node with very many neighbours is not
    collected.  Each round is written to the shared folder.
    """
    ways = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(ways.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    n, total = labels.agg(F.count(F.lit(1)), F.sum(F.col("component").cast("decimal(38,0)"))).first()
    while n:
        theirs = labels.select(F.col("node").alias("a"), "component")
        heard = ways.join(theirs, "a").select(F.col("b").alias("node"), "component").unionByName(labels)
        lowest = heard.groupBy("node").agg(F.min("component").alias("component"))
        further = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        jumped = lowest.join(further, "component").select("node", F.least("component", "further").alias("component"))
        labels = stored(jumped.coalesce(max(LEAST_TASKS, -(-n // LABELS_PER_TASK))))
        before, total = total, labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if total == before:
            break
    return labels
