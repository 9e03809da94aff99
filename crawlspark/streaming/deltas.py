"""Streaming folds kept as mergeable deltas.

Each micro-batch writes its own summary to a folder named after its stream and
its batch id, and lists it in the table's manifest. A batch that is listed counts
once: a repeated try of it changes nothing, one that failed before it was listed is
written again. A stream's id lives beside its checkpoint, so a stream begun anew
writes beside what an older one left. Readers add up the summaries of one version,
in any order. Nothing is updated in place and no key has to fit into the state of
one task.

Summaries are merged in tiers: as soon as `FAN` of one level are live, they become
one of the next, which says whose batches it holds. So a table of n batches has
fewer than `FAN` folders a level, and log n levels. A merge that fails leaves
nothing that counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..stored import files
from ..stored.manifest import GRACE, KEPT, Entry, Manifest, Version

Summary = Callable[[DataFrame], DataFrame]

#: Summaries of a level that are merged into one of the next.
FAN = 8


class BatchId(int):
    """The number of a micro-batch, with the id of its stream."""

    stream = "0"

    def __new__(cls, number: int, stream: str) -> BatchId:
        self = super().__new__(cls, number)
        self.stream = stream
        return self


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of a stream, in a file beside its checkpoint that its first batch makes."""
    path = f"{checkpoint}/crawl_stream_id"
    found = files.read_text(spark, path)
    if found is None:
        files.create(spark, path, uuid.uuid4().hex)
        found = files.read_text(spark, path)
    return found


def folder_of(batch_id: int) -> str:
    return f"stream={getattr(batch_id, 'stream', '0')}/batch_id={int(batch_id)}"


def folder(path: str, batch_id: int) -> str:
    return f"{path}/{folder_of(batch_id)}"


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Rows of a batch as they are, replacing what an earlier try left; for tables that aren't merged."""
    rows.write.mode("overwrite").parquet(folder(path, batch_id))


# --- merged tables -----------------------------------------------------------

def _covers(entry: Entry, stream: str, number: int) -> bool:
    return any(low <= number <= high for low, high in entry.tags["batches"].get(stream, ()))


def _ranges(lists: list[list[list[int]]]) -> list[list[int]]:
    """Ranges of batch numbers, joined where one follows the other."""
    out: list[list[int]] = []
    for low, high in sorted(tuple(r) for ranges in lists for r in ranges):
        if out and low <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


def add_batch(summary: DataFrame, path: str, batch_id: int, merge: Summary, schema: T.StructType,
              fan: int = FAN) -> None:
    """Write and list the summary of a batch, unless it counts already; then merge full tiers."""
    spark = summary.sparkSession
    manifest = Manifest(spark, path)
    stream, number = getattr(batch_id, "stream", "0"), int(batch_id)

    def counts(version: Version) -> bool:
        return any(_covers(e, stream, number) for e in version.entries)

    if not counts(manifest.latest()):
        summary.write.mode("overwrite").parquet(folder(path, batch_id))
        new = Entry(folder_of(batch_id), {"level": 0, "batches": {stream: [[number, number]]}})
        manifest.commit(lambda v: None if counts(v) else Version(0, (*v.entries, new), v.applied))
    compact(spark, path, merge, schema, fan)


def compact(spark: SparkSession, path: str, merge: Summary, schema: T.StructType, fan: int = FAN,
            kept: int = KEPT, grace: float = GRACE) -> int:
    """Merge every tier that is full; the number of merges. Readers of older versions are left alone for `grace` seconds."""
    manifest, merges = Manifest(spark, path), 0
    while True:
        version = manifest.latest()
        levels = sorted({e.tags["level"] for e in version.entries})
        full = [level for level in levels if sum(e.tags["level"] == level for e in version.entries) >= fan]
        if not full:
            if merges:
                manifest.vacuum(kept, grace)
            return merges
        chosen = [e for e in version.entries if e.tags["level"] == full[0]][:fan]
        streams = sorted({s for e in chosen for s in e.tags["batches"]})
        merged = Entry(manifest.new_folder("merged"), {"level": full[0] + 1, "batches": {
            s: _ranges([e.tags["batches"].get(s, []) for e in chosen]) for s in streams}})
        rows = manifest.read(schema, version, lambda e: e in chosen)
        merge(rows).select(*schema.names).write.parquet(f"{manifest.path}/{merged.folder}")

        def change(now: Version) -> Version | None:
            if not set(e.folder for e in chosen) <= set(e.folder for e in now.entries):
                return None  # someone else merged them meanwhile; this merge doesn't count
            return Version(0, (*[e for e in now.entries if e not in chosen], merged), now.applied)

        manifest.commit(change)
        merges += 1


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All summaries of the newest version."""
    return Manifest(spark, path).read(schema)
