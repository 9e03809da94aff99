"""Stored tables that are changed by key, a bucket at a time.

Rows lie in buckets by a hash of their key. An upsert aggregates what comes in,
reads only the buckets that it touches, merges both, writes those buckets anew and
lists them in the next version in place of the old ones; files of other buckets
stay as they are. If another writer changed one of the touched buckets meanwhile,
the merge is done again on the newer version. A batch of a stream is applied once:
the version says how far each stream has come.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import progress, runs
from ..session import new_run_dir
from .manifest import GRACE, KEPT, Entry, Manifest, Version

BUCKET = "_bucket"
_RETRIES = 20

Merge = Callable[[DataFrame], DataFrame]


def bucket_of(keys: list[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class BucketTable:
    """A stored table of `schema`, whose rows of equal `keys` are merged by `merge`.

    `merge` takes rows of old and new alike and gives the rows to keep. It has to
    keep rows of different keys apart.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], merge: Merge,
                 buckets: int = 64):
        self.spark, self.schema, self.keys, self.merge, self.buckets = spark, schema, keys, merge, buckets
        self.manifest = Manifest(spark, path)

    def upsert(self, rows: DataFrame, batch_id: int | None = None) -> list[int]:
        """Merge rows into the table; the buckets that were written anew.

        With the id of a batch of a stream, a batch that is applied already, or an
        earlier one, changes nothing. Batches of a stream come in order.
        """
        stream = None if batch_id is None else getattr(batch_id, "stream", "0")
        if self._applied(self.manifest.latest(), stream, batch_id):
            return []
        incoming = self._staged(rows)
        # at most as many numbers as there are buckets
        touched = sorted(r[0] for r in incoming.select(BUCKET).distinct().collect())
        for _ in range(_RETRIES):
            before = self.manifest.latest()
            old = self._of(before, touched)
            written = self._merged(before, touched, incoming)

            def change(now: Version) -> Version | None:
                if self._applied(now, stream, batch_id) or self._of(now, touched) != old:
                    return None
                kept = [e for e in now.entries if e.tags["bucket"] not in touched]
                applied = now.applied if stream is None else now.applied | {stream: int(batch_id)}
                return Version(0, (*kept, *written), applied)

            after = self.manifest.commit(change)
            if {e.folder for e in written} <= {e.folder for e in after.entries}:
                return touched
            if self._applied(after, stream, batch_id):
                return []
        raise RuntimeError(f"{self.manifest.path}: other writers changed the same buckets {_RETRIES} times")

    @staticmethod
    def _applied(version: Version, stream: str | None, batch_id: int | None) -> bool:
        return stream is not None and version.applied.get(stream, -1) >= int(batch_id)

    @staticmethod
    def _of(version: Version, buckets: list[int]) -> list[Entry]:
        return [e for e in version.entries if e.tags["bucket"] in buckets]

    def _staged(self, rows: DataFrame) -> DataFrame:
        """What comes in, merged among itself and stored with its buckets."""
        path = new_run_dir(self.spark, "upsert")
        merged = self.merge(rows.select(*self.schema.names))
        marked = merged.select(*self.schema.names).withColumn(BUCKET, bucket_of([F.col(k) for k in self.keys], self.buckets))
        marked.write.parquet(path)
        return self.spark.read.schema(marked.schema).parquet(path)

    def _merged(self, before: Version, touched: list[int], incoming: DataFrame) -> list[Entry]:
        """New folders of the touched buckets; they don't count yet."""
        old = self.manifest.read(self.schema, before, lambda e: e.tags["bucket"] in touched)
        both = self.merge(old.unionByName(incoming.drop(BUCKET))).select(*self.schema.names)
        marked = both.withColumn(BUCKET, bucket_of([F.col(k) for k in self.keys], self.buckets))
        folder = self.manifest.new_folder()
        # a rebalance keeps a bucket in few files, and splits one that is too large for a task
        marked.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.manifest.path}/{folder}")
        return [Entry(f"{folder}/{BUCKET}={b}", {"bucket": b}) for b in touched]

    def read(self, version: Version | None = None) -> DataFrame:
        return self.manifest.read(self.schema, version)

    def look_up(self, **key: str) -> DataFrame:
        """The rows of one key; only its bucket is read, and the filter reaches its scan."""
        columns = [F.lit(key[k]).cast(self.schema[k].dataType) for k in self.keys]
        bucket = self.spark.range(1).select(bucket_of(columns, self.buckets)).first()[0]
        rows = self.manifest.read(self.schema, None, lambda e: e.tags["bucket"] == bucket)
        for name, column in zip(self.keys, columns):
            rows = rows.where(F.col(name).eqNullSafe(column))
        return rows

    def vacuum(self, kept: int = KEPT, grace: float = GRACE) -> list[str]:
        return self.manifest.vacuum(kept, grace)


# --- site statistics ---------------------------------------------------------

SITE_STATS = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("site", T.StringType()),
    T.StructField("last_update", T.TimestampNTZType()),
    *[T.StructField(c, T.LongType()) for c in progress.SITE_COUNTERS],
])


def site_stats_table(spark: SparkSession, path: str, buckets: int = 64) -> BucketTable:
    """Site statistics that deltas are added to: rows are updated where they exist and inserted where they don't.
    Rows come in as `progress.site_stats` gives them. All sites of a job share a bucket only by chance."""
    return BucketTable(spark, path, SITE_STATS, progress.SITE_KEYS, progress.add_site_stats, buckets)


# --- job runs ----------------------------------------------------------------

RUN_FACTS = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("started_at", T.TimestampNTZType()),
    T.StructField("first_start", T.LongType()), T.StructField("last_start", T.LongType()),
    T.StructField("end", T.StructType([
        T.StructField("ts", T.TimestampNTZType()), T.StructField("event_id", T.LongType()),
        T.StructField("stage", T.StringType()), T.StructField("note", T.StringType()),
    ])),
])


def run_facts(events: DataFrame) -> DataFrame:
    """Starts of runs, and the last completion of a job as a row without a start."""
    return runs.run_starts(events).unionByName(runs.run_ends(events), allowMissingColumns=True)


def _split(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (facts.where("started_at IS NOT NULL").drop("end"),
            facts.where("started_at IS NULL").select("job_id", "end"))


def add_facts(facts: DataFrame) -> DataFrame:
    starts, ends = _split(facts)
    return runs.add_starts(starts).unionByName(runs.add_ends(ends), allowMissingColumns=True)


def job_runs_table(spark: SparkSession, path: str, buckets: int = 64) -> BucketTable:
    """Starts and completions of jobs, in one table, so that a version has both of a batch or neither.
    Rows come in as `run_facts` gives them; `read_job_runs` and `look_up_job_runs` give runs."""
    return BucketTable(spark, path, RUN_FACTS, ["job_id"], add_facts, buckets)


def read_job_runs(table: BucketTable) -> DataFrame:
    return runs.join_runs(*_split(table.read()))


def look_up_job_runs(table: BucketTable, job_id: str) -> DataFrame:
    return runs.join_runs(*_split(table.look_up(job_id=job_id)))
