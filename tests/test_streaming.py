"""Streams over several files give what the batch gives."""

import pytest
from pyspark.sql import functions as F

from crawlspark.operators import metrics, progress, runs, timeline
from crawlspark.operators import pages as page_ops
from crawlspark.sources import derived, schemas, tables
from crawlspark.streaming import pages as page_stream
from crawlspark.streaming import progress as stream


@pytest.fixture(scope="module", params=["in order", "backwards"])
def source(request, spark, tmp_path_factory):
    """Progress events in five files, in time order or against it."""
    path = str(tmp_path_factory.mktemp("events"))
    events = derived.dirty_events(spark, "/root/testdata/sf0.001")
    for part in range(5) if request.param == "in order" else reversed(range(5)):
        events.where((F.col("event_id") >= part * 200) & (F.col("event_id") < part * 200 + 200)).coalesce(
            1).write.mode("append").parquet(path)
    return path, spark.read.parquet(path)


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_folds_equal_the_batch(spark, source, tmp_path):
    path, events = source
    out = str(tmp_path)
    counts = {}
    sinks = {
        "stats": stream.site_stats_sink(f"{out}/stats"), "runs": stream.job_runs_sink(f"{out}/runs"),
        "running": stream.running_jobs_sink(f"{out}/running"), "audit": stream.audit_sink(f"{out}/audit"),
    }
    query = stream.run_progress(
        tables.stream(spark, schemas.PROGRESS_EVENT, path, files_per_trigger=1), sinks, f"{out}/checkpoint",
        on_rejects=lambda batch, seen: counts.update({batch: seen}))
    query.awaitTermination()
    valid = progress.valid_events(events)
    assert len(counts) == 5
    assert sum(c["valid"] for c in counts.values()) == valid.count()
    assert sum(c["rejected"] for c in counts.values()) == progress.event_rejects(events).count() > 0
    assert rows(stream.read_site_stats(spark, f"{out}/stats")) == rows(progress.site_stats(progress.site_deltas(valid)))
    assert rows(stream.read_job_runs(spark, f"{out}/runs")) == rows(runs.job_runs(valid))
    assert rows(stream.read_running_jobs(spark, f"{out}/running")) == rows(timeline.running_jobs(valid))
    assert spark.read.json(f"{out}/audit").count() == valid.count()


def test_failing_sink_stops_no_other_and_is_retried(spark, source, tmp_path):
    path, events = source
    out, broken = str(tmp_path), {"on": True}

    def fragile(batch, batch_id):
        if broken["on"] and batch_id == 1:
            raise OSError("disk full")

    def start():
        return stream.run_progress(
            tables.stream(spark, schemas.PROGRESS_EVENT, path, files_per_trigger=1),
            {"fragile": fragile, "stats": stream.site_stats_sink(f"{out}/stats")}, f"{out}/checkpoint")

    query = start()
    with pytest.raises(Exception, match="disk full"):
        query.awaitTermination()
    assert list((tmp_path / "stats").glob("stream=*/batch_id=1"))  # the other sink ran
    broken["on"] = False
    start().awaitTermination()
    want = progress.site_stats(progress.site_deltas(progress.valid_events(events)))
    assert rows(stream.read_site_stats(spark, f"{out}/stats")) == rows(want)  # batch 1 counts once


def test_streams_begun_anew_add_up(spark, source, tmp_path):
    path, events = source
    out = str(tmp_path)
    for half in (0, 1):
        events.where(F.col("event_id") % 2 == half).coalesce(1).write.parquet(f"{out}/in{half}")
        stream.run_progress(
            tables.stream(spark, schemas.PROGRESS_EVENT, f"{out}/in{half}"),
            {"stats": stream.site_stats_sink(f"{out}/stats"), "running": stream.running_jobs_sink(f"{out}/running")},
            f"{out}/checkpoint{half}", rejects=stream.table_sink(f"{out}/rejects")).awaitTermination()
    valid = progress.valid_events(events)
    want = progress.site_stats(progress.site_deltas(valid))
    assert rows(stream.read_site_stats(spark, f"{out}/stats")) == rows(want)
    assert rows(stream.read_running_jobs(spark, f"{out}/running")) == rows(timeline.running_jobs(valid))
    rejected = spark.read.parquet(f"{out}/rejects").drop("stream", "batch_id")
    assert rows(rejected) == rows(progress.event_rejects(events))


def test_late_rows_count_in_rates(spark, folder, tmp_path):
    seen = derived.observations(spark, folder)
    seen.repartitionByRange(4, F.desc("ts")).write.parquet(f"{tmp_path}/in")
    stream.run_batches(
        tables.stream(spark, seen.schema, f"{tmp_path}/in", files_per_trigger=1),
        {"rates": stream.pages_rate_sink(f"{tmp_path}/out")}, f"{tmp_path}/c").awaitTermination()
    assert rows(stream.read_pages_rate(spark, f"{tmp_path}/out")) == rows(metrics.pages_rate(seen))


def test_rates_equal_the_batch(spark, folder, tmp_path):
    seen = derived.observations(spark, folder)
    seen.coalesce(1).sortWithinPartitions("ts").write.parquet(f"{tmp_path}/in")
    streamed = stream.stream_pages_rate(tables.stream(spark, seen.schema, f"{tmp_path}/in"))
    streamed.writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
        "checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    last = seen.where("status = 'success'").agg(F.max("ts")).first()[0]
    closed = F.timestamp_add("MINUTE", F.lit(15), F.col("window_start")) <= F.lit(last)
    assert rows(got) == rows(metrics.pages_rate(seen).where(closed)) and got.count() > 100


def test_pages_equal_the_batch(spark, folder, tmp_path):
    fetched = derived.fetches(spark, folder)
    fetched.repartition(3).write.parquet(f"{tmp_path}/in")

    def source():
        return tables.stream(spark, schemas.FETCH_RESPONSE, f"{tmp_path}/in", files_per_trigger=1)

    page_stream.stream_retrievals(source(), f"{tmp_path}/r", f"{tmp_path}/c1").awaitTermination()
    page_stream.stream_notifications(source(), "t", f"{tmp_path}/c2", path=f"{tmp_path}/n").awaitTermination()
    stored = page_ops.stored_pages(fetched)
    assert rows(tables.retrievals(spark, f"{tmp_path}/r")) == rows(page_ops.retrievals(stored))
    assert rows(spark.read.text(f"{tmp_path}/n")) == rows(page_ops.notifications(stored, "t").select("value"))
    again = tables.fetches(spark, f"{tmp_path}/in")
    assert again.count() == fetched.count()
