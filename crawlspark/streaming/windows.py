"""Windowed rates that close as the stream goes on, and lose nothing.

Counts of open windows are kept as mergeable deltas. The watermark is the latest
time seen less the allowed lateness; it lives in a manifest, so a restart goes on
where it was. When it passes the end of windows, these are emitted, once each. Rows
that come for a window that has closed are counted in a side table instead of being
dropped. What was emitted, the side table and the windows still open add up to the
rates of all rows, in whatever order they came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..operators import metrics
from ..stored.manifest import Manifest, Version
from . import deltas
from .progress import PAGE_COUNTS, Sink, add_page_counts

_MARK = "watermark_us"


class ClosingRates:
    """Pages per second by site and five-minute window below `path`."""

    def __init__(self, spark: SparkSession, path: str, lateness_seconds: int = 600, fan: int = deltas.FAN):
        self.spark, self.path, self.fan = spark, path.rstrip("/"), fan
        self.lateness = lateness_seconds * 1_000_000
        self.marks = Manifest(spark, f"{self.path}/marks")

    def _mark(self, version: Version) -> int | None:
        return version.applied.get(_MARK)

    def _closed(self, mark: int | None):
        """Whether a window has ended by a watermark."""
        end = times.micros(F.col("window_start")) + metrics.RATE_WINDOW * 1_000_000
        return F.lit(False) if mark is None else end <= F.lit(mark)

    def sink(self) -> Sink:
        def consume(seen: DataFrame, batch_id: int) -> None:
            stream = getattr(batch_id, "stream", "0")
            before = self.marks.latest()
            if before.applied.get(stream, -1) >= int(batch_id):
                return  # a batch that is repeated after it was closed
            mark = self._mark(before)
            counts = metrics.pages_counted(seen)
            deltas.add_batch(counts.where(~self._closed(mark)), f"{self.path}/open", batch_id, add_page_counts,
                             PAGE_COUNTS, self.fan)
            deltas.add_batch(counts.where(self._closed(mark)), f"{self.path}/late", batch_id, add_page_counts,
                             PAGE_COUNTS, self.fan)
            latest = seen.agg(F.max(times.micros(F.col("ts")))).first()[0]
            after = mark if latest is None else max(latest - self.lateness, mark if mark is not None else latest - self.lateness)
            if after != mark:
                ended = self._open().where(self._closed(after) & ~self._closed(mark))
                deltas.add_batch(ended, f"{self.path}/closed", batch_id, add_page_counts, PAGE_COUNTS, self.fan)
            applied = {stream: int(batch_id)} | ({} if after is None else {_MARK: after})
            self.marks.commit(lambda v: Version(0, (), v.applied | applied))
            self.marks.vacuum(2)

        return consume

    def _open(self) -> DataFrame:
        """Counts of rows that came in time, of windows that have closed and that haven't."""
        return add_page_counts(deltas.read_batches(self.spark, f"{self.path}/open", PAGE_COUNTS))

    def closed(self) -> DataFrame:
        """The windows that have been emitted, as they were then."""
        return metrics.rate_of_pages(deltas.read_batches(self.spark, f"{self.path}/closed", PAGE_COUNTS))

    def still_open(self) -> DataFrame:
        mark = self._mark(self.marks.latest())
        return metrics.rate_of_pages(self._open().where(~self._closed(mark)))

    def late(self) -> DataFrame:
        """Pages that came for windows that had closed, by window and site."""
        return add_page_counts(deltas.read_batches(self.spark, f"{self.path}/late", PAGE_COUNTS))

    def all(self) -> DataFrame:
        """The rates of all rows: emitted, open and late together."""
        mark = self._mark(self.marks.latest())
        emitted = deltas.read_batches(self.spark, f"{self.path}/closed", PAGE_COUNTS)
        return metrics.rate_of_pages(
            emitted.unionByName(self.late()).unionByName(self._open().where(~self._closed(mark))))

