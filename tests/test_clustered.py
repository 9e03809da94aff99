"""Point and page reads: the same rows as a full scan, from fewer row groups."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlspark.operators import runs
from crawlspark.stored import clustered


def rows(df):
    return list(map(str, df.collect()))


def scanned(df):
    """Rows that left the scans of a query that has run."""
    def walk(node):
        kids = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            kids = [node.executedPlan()]
        elif "QueryStage" in node.nodeName():
            kids = [node.plan()]
        if node.nodeName().startswith("Scan parquet"):
            return node.metrics().apply("numOutputRows").value()
        return sum(map(walk, kids))

    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().executedPlan().executeCollect()
    return walk(plan)


@pytest.fixture(scope="module")
def some_runs(spark):
    number = F.col("n")
    return spark.range(20000).withColumnRenamed("id", "n").select(
        F.concat(F.lit("job-"), F.lpad((number * 7919 % 5000).cast("string"), 5, "0")).alias("id"),
        F.concat(F.lit("job-"), F.lpad((number * 7919 % 5000).cast("string"), 5, "0")).alias("job_id"),
        F.when(number % 100 != 0, F.timestamp_seconds(number * 613 % 9000)).cast("timestamp_ntz").alias("started_at"),
        F.lit(None).cast("timestamp_ntz").alias("finished_at"),
        F.when(number % 3 == 0, "error").otherwise("success").alias("status"),
        number.cast("string").alias("error_message"))


def test_point_reads_skip_row_groups(spark, some_runs, tmp_path):
    table = clustered.runs_by_id(spark, str(tmp_path))
    table.write(some_runs, row_group_bytes=4096)
    for wanted in ("job-00000", "job-01234", "job-04999"):
        found = runs.get_job(table.point(wanted), wanted)
        assert sorted(rows(found)) == sorted(rows(some_runs.where(F.col("id") == wanted))) and found.count() == 4
        assert scanned(table.point(wanted)) <= 1000 < 20000  # of row groups of some hundred rows
    assert table.point("job-99999").count() == 0 and table.point("a").count() == 0
    assert sorted(rows(table.read())) == sorted(rows(some_runs))
    # a file that holds the value's range, but not the value: the row groups' Bloom filters know
    assert scanned(table.point("job-01234x")) == 0


@pytest.mark.parametrize("limit, offset", [(5, 0), (50, 13), (500, 19000), (10, 19995), (10, 30000)])
def test_pages(spark, some_runs, tmp_path, limit, offset):
    table = clustered.runs_by_time(spark, str(tmp_path))
    table.write(some_runs.repartition(3), files=16)
    then = ["id", "error_message"]
    order = [F.col("started_at").desc_nulls_last(), *then]
    assert rows(table.newest(limit, offset, then)) == rows(some_runs.orderBy(*order).offset(offset).limit(limit))
    if offset < 100:
        assert scanned(table.newest(limit, offset, then)) < 12000
    failed = F.col("status") == "error"
    want = rows(some_runs.where(failed).orderBy(*order).offset(offset).limit(limit))
    assert rows(table.newest(limit, offset, then, failed)) == want == rows(table.newest(limit, offset, then, failed, 0.3))


def test_sites_of_a_job(spark, tmp_path):
    table = clustered.sites_by_job(spark, str(tmp_path))
    number = F.col("id")
    stats = spark.range(3000).select(
        F.when(number % 50 != 7, F.concat(F.lit("j"), (number % 3).cast("string"))).alias("job_id"),
        F.concat(F.lit("s"), number.cast("string")).alias("site"),
        F.timestamp_seconds(number * 31 % 500).cast("timestamp_ntz").alias("last_update"),
        *[(number % 9).alias(c.name) for c in table.schema[3:]])
    table.write(stats)
    for job in ("j0", "j1", "none"):
        assert rows(runs.list_job_sites(table.point(job), job, 20, 5)) == rows(runs.list_job_sites(stats, job, 20, 5))
    table.write(stats.limit(0))
    assert table.read().count() == 0 and table.newest(3).count() == 0 and table.point("j0").count() == 0
