"""Ordered per-key computations that don't depend on how rows spread over keys.

A window over one key runs in one task, however large the key is. So rows are
range-partitioned once, by key, position and tie-break, and kept in a table in
the shared folder together with their partition number, which fixes the
partitions. Values are computed inside a partition. A key that goes on from one
partition to the next is carried on by one summary row per partition and key; of
these at most one per partition has earlier rows, so what is broadcast has at
most as many rows as there are partitions. Results are exact, and the plan is
the same for any sizes of keys. The order must be total: ties are split like any
other rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_run_dir

PART = "_part"


def ordered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows in a table of fixed partitions, in order of `keys` and `order` from one to the next."""
    spark = df.sparkSession
    path = new_run_dir(spark, "ordered")
    spread = df.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id())
    spread.write.parquet(path)
    return spark.read.schema(spread.schema).parquet(path)


def inside(keys: list[str], order: list) -> Window:
    """Rows of a key in one partition, in order."""
    return Window.partitionBy(PART, *keys).orderBy(*order)


def running(keys: list[str], order: list) -> Window:
    """Those rows up to and including the current one."""
    return inside(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def earlier(keys: list[str]) -> Window:
    """Summaries of the same key in earlier partitions."""
    return Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def carried(summaries: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """What comes into a partition from earlier ones; only for the keys that go on there."""
    found = summaries.select(
        PART, *keys, F.count(F.lit(1)).over(earlier(keys)).alias("_parts"),
        *[v.alias(name) for name, v in values.items()])
    return found.where(F.col("_parts") > 0).drop("_parts")


def carry(local: DataFrame, coming: DataFrame, keys: list[str]) -> DataFrame:
    """Give every row what is carried into its partition; NULL where nothing is."""
    names = {c: f"_of_{c}" for c in [PART, *keys]}
    renamed = coming.withColumnsRenamed(names)
    same = reduce(lambda a, b: a & b, [local[c].eqNullSafe(renamed[n]) for c, n in names.items()])
    return local.join(F.broadcast(renamed), same, "left").drop(*names.values())


def row_numbers(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Number the rows of each key in order, from 1."""
    rows = ordered(df, keys, order)
    local = rows.withColumn(name, F.row_number().over(inside(keys, order)).cast("bigint"))
    counts = rows.groupBy(PART, *keys).agg(F.count(F.lit(1)).alias("_n"))
    coming = carried(counts, keys, _before=F.sum("_n").over(earlier(keys)))
    return carry(local, coming, keys).withColumn(
        name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_before", PART)


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Sum of `value` over the rows of the key up to and including this one."""
    rows = ordered(df, keys, order)
    local = rows.withColumn(name, F.coalesce(F.sum(value).over(running(keys, order)), F.lit(0)))
    sums = rows.groupBy(PART, *keys).agg(F.sum(value).alias("_sum"))
    coming = carried(sums, keys, _before=F.sum("_sum").over(earlier(keys)))
    return carry(local, coming, keys).withColumn(
        name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_before", PART)


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Sum of `value` over all rows up to and including this one. Only a sum per
    partition passes through one task."""
    return running_sum(df, [], order, value, name)


def previous(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """`value` of the preceding row of the key; NULL for the first. `value` has no NULLs."""
    rows = ordered(df, keys, order)
    window = inside(keys, order)
    local = rows.withColumn(name, F.lag(value).over(window))
    lasts = rows.withColumn("_next", F.lead(F.lit(1)).over(window)).where(F.col("_next").isNull())
    coming = carried(lasts, keys, _before=F.last(value).over(earlier(keys)))
    return carry(local, coming, keys).withColumn(name, F.coalesce(name, "_before")).drop("_before", PART)
