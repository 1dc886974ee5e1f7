"""Loading raw feeds into a store: read, clean, replace."""

from __future__ import annotations

from pyspark.errors import PySparkException

from floorledger.ledgers import DAY_COLUMN
from floorledger.sinks.store import LedgerStore
from floorledger.sources.cleaning import CLEANERS
from floorledger.sources.feeds import FeedRefused, read_feed


class FeedsRefused(ValueError):
    """Feeds that were not loaded, with the reason of each; ``loaded`` has the rows of the others."""

    def __init__(self, refused: dict[str, str], loaded: dict[str, int]) -> None:
        super().__init__("; ".join(f"{feed}: {why}" for feed, why in refused.items()))
        self.refused, self.loaded = refused, loaded


def load_feed(
    store: LedgerStore, feed: str, path: str, separator: str = ",", day_first: bool = False, source: str | None = None
) -> int:
    """Load one feed and give back its rows; ``source`` names the delivery in the load log."""
    rows = CLEANERS[feed](read_feed(store.spark, feed, path, separator), day_first)
    write = store.replace_range if feed in DAY_COLUMN else store.refresh
    return write(feed, rows, path.rstrip("/").rsplit("/", 1)[-1], source)


def load_feeds(
    store: LedgerStore, files: dict[str, str], separator: str = ",", day_first: bool = False
) -> dict[str, int]:
    """Load any subset of the feeds; each one is published on its own.  Returns rows per loaded feed.

    ``files`` maps a feed to a file or a directory of part files, delimited text (plain, ``.gz`` or ``.bz2``) or Parquet.
    ``day_first`` says how days like 03/04/2024 are written.  A feed that is refused changes nothing; the others are
    loaded, and then the refusals are raised together.
    """
    unknown = sorted(set(files) - set(CLEANERS))
    if unknown:
        raise ValueError(f"no such feed: {', '.join(unknown)}")
    loaded, refused = {}, {}
    for feed in CLEANERS:
        if not files.get(feed):
            continue
        try:
            loaded[feed] = load_feed(store, feed, files[feed], separator, day_first)
        except (FeedRefused, PySparkException) as error:
            refused[feed] = f"{files[feed]}: {str(error).splitlines()[0]}"
    if refused:
        raise FeedsRefused(refused, loaded)
    return loaded
