"""Stored tables that are read by point and by page.

Rows are range-partitioned and sorted by their clustering columns, so a value lies
in few files and few row groups of them. The manifest keeps the range of the first
clustering column in every file; row groups are skipped by the statistics and the
Bloom filters that Parquet keeps. A point read opens the files whose range holds
the value; a page of the newest rows opens the files that can hold it, which the
manifest's ranges and counts tell, and sorts what they hold.

A write replaces the table's rows in one version. Repeated rows stay; nulls of the
first column sort first, are counted on their own and can be read as pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .manifest import GRACE, KEPT, Entry, Manifest, Version

#: Bytes of a row group: small enough that a point read reads little, large enough to compress.
ROW_GROUP_BYTES = 16 << 20


class ClusteredTable:
    """A table of `schema` below `path`, clustered by the columns `by`; `bloom`: columns with Bloom filters."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, by: list[str], bloom: list[str] = ()):
        self.spark, self.schema, self.by, self.bloom = spark, schema, by, list(bloom)
        self.manifest = Manifest(spark, path)

    def _order(self) -> Column:
        """The first clustering column as a number or text that ranges are told by."""
        first = F.col(self.by[0])
        if isinstance(self.schema[self.by[0]].dataType, (T.TimestampNTZType, T.TimestampType)):
            return F.unix_micros(first.cast("timestamp"))
        return first

    def _value(self, order) -> Column:
        """The value of the first clustering column that `_order` gave, as a literal that reaches the scan."""
        kind = self.schema[self.by[0]].dataType
        if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            return F.timestamp_micros(F.lit(order)).cast(kind)
        return F.lit(order).cast(kind)

    def write(self, rows: DataFrame, row_group_bytes: int = ROW_GROUP_BYTES, files: int | None = None) -> Version:
        """Replace the rows of the table; adaptive execution sizes its files unless their number is given."""
        folder = self.manifest.new_folder()
        place = f"{self.manifest.path}/{folder}"
        ranges = [files] if files else []
        writer = rows.select(*self.schema.names).repartitionByRange(*ranges, *self.by).sortWithinPartitions(*self.by).write.option(
            "parquet.block.size", row_group_bytes).option("parquet.page.size", max(1024, row_group_bytes // 16))
        for column in self.bloom:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(place)
        written = self.spark.read.schema(self.schema).parquet(place)
        found = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(
            F.min(self._order()).alias("low"), F.max(self._order()).alias("high"),
            F.count(F.lit(1)).alias("rows"), F.count_if(F.col(self.by[0]).isNull()).alias("nulls")).collect()
        entries = tuple(Entry(f"{folder}/{r['file']}", {k: r[k] for k in ("low", "high", "rows", "nulls")}) for r in found)
        return self.manifest.commit(lambda v: Version(0, entries, v.applied))

    def read(self) -> DataFrame:
        return self.manifest.read(self.schema)

    def point(self, value) -> DataFrame:
        """The rows whose first clustering column has this value."""
        low = value
        if not isinstance(value, (int, str)):
            low = self.spark.range(1).select(F.unix_micros(F.lit(value).cast("timestamp"))).first()[0]
        rows = self.manifest.read(
            self.schema, None, lambda e: e.tags["low"] is not None and e.tags["low"] <= low <= e.tags["high"])
        return rows.where(F.col(self.by[0]) == F.lit(value))

    def newest(self, limit: int, offset: int = 0, then: list[str] = (), where: Column | None = None,
               share: float = 1.0) -> DataFrame:
        """Rows in falling order of the first clustering column (then rising by `then`), `limit` after `offset`.

        With a filter, files are opened for `share` of their rows passing it; if
        fewer do, all files are.
        """
        wanted = int((offset + limit) / share) + 1
        entries = self.manifest.latest().entries
        ranges = sorted((e for e in entries if e.tags["low"] is not None), key=lambda e: e.tags["low"], reverse=True)
        least, have = None, 0
        for entry in ranges:  # rows at or above the low end of these files are at least so many
            have += entry.tags["rows"] - entry.tags["nulls"]
            least = entry.tags["low"]
            if have >= wanted:
                break
        else:
            least = None  # all of them, and the rows without a value

        def page(least) -> DataFrame:
            rows = self.manifest.read(self.schema, None, lambda e: least is None or (
                e.tags["high"] is not None and e.tags["high"] >= least))
            if least is not None:
                rows = rows.where(F.col(self.by[0]) >= self._value(least))
            return rows if where is None else rows.where(where)

        rows = page(least)
        if where is not None and least is not None and len(rows.select(F.lit(1)).head(offset + limit)) < offset + limit:
            rows = page(None)
        return rows.orderBy(F.col(self.by[0]).desc_nulls_last(), *then).offset(offset).limit(limit)

    def vacuum(self, kept: int = KEPT, grace: float = GRACE) -> list[str]:
        return self.manifest.vacuum(kept, grace)


# --- job runs and site statistics ---------------------------------------------

RUNS = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("job_id", T.StringType()),
    T.StructField("started_at", T.TimestampNTZType()), T.StructField("finished_at", T.TimestampNTZType()),
    T.StructField("status", T.StringType()), T.StructField("error_message", T.StringType()),
])


def runs_by_id(spark: SparkSession, path: str) -> ClusteredTable:
    """Runs for `get_job`: a point read by id."""
    return ClusteredTable(spark, path, RUNS, ["id", "started_at"], ["id"])


def runs_by_time(spark: SparkSession, path: str) -> ClusteredTable:
    """Runs for `list_jobs`: pages of the newest."""
    return ClusteredTable(spark, path, RUNS, ["started_at", "id"])


def sites_by_job(spark: SparkSession, path: str) -> ClusteredTable:
    """Site statistics for `list_job_sites`: a point read by job, then a page of it."""
    from .buckets import SITE_STATS

    return ClusteredTable(spark, path, SITE_STATS, ["job_id", "last_update", "site"], ["job_id"])
