"""A landing directory per feed: every new file is loaded once, in order of arrival.

Structured Streaming only keeps track of which files are new; each file goes through the same range replace as a
manual load.  The load log names a delivery by its full path and modification time, so equal names in two
directories, or a renewed checkpoint, neither hide a file nor load one twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from floorledger.sinks.loading import load_feed
from floorledger.sinks.store import LedgerStore

FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
# Files of one micro-batch: their names are all that comes to the driver.
FILES_PER_BATCH = 100


def load_landing(
    store: LedgerStore, feed: str, directory: str, checkpoint: str, separator: str = ",", day_first: bool = False
) -> StreamingQuery:
    """Load what has arrived since the last call with the same checkpoint, then stop.

    A file that is refused fails its batch, and is tried again by the next call.
    """
    arrivals = (
        store.spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("maxFilesPerTrigger", FILES_PER_BATCH)
        .load(directory)
        .select("path", F.unix_micros("modificationTime").alias("modified"))  # the content is never read here
    )

    def load(files: DataFrame, batch: int) -> None:
        for row in files.orderBy("modified", "path").collect():
            source = f"{row.path}@{row.modified}"
            # A batch that failed midway is run again: what it had loaded is in the log.
            if not store.has_loaded(feed, source):
                load_feed(store, feed, row.path, separator, day_first, source)

    return (
        arrivals.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
