"""Progress event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import constants as C
from ..operators import metrics, progress, runs, timeline
from . import deltas

Sink = Callable[[DataFrame, int], None]


def run_batches(rows: DataFrame, sinks: dict[str, Sink], checkpoint: str, *,
                trigger: dict | None = None,
                before: Callable[[DataFrame, int], DataFrame] | None = None) -> StreamingQuery:
    """Hand each micro-batch of a stream to every sink.

    All sinks see the batch even if one of them fails; then the batch fails and
    is tried again, so sinks must be idempotent by batch id, which is a number
    that also knows its stream. `before` may look at the batch and change it.
    """
    stream = []

    def consume(batch: DataFrame, number: int) -> None:
        if not stream:
            stream.append(deltas.stream_id(batch.sparkSession, checkpoint))
        batch_id = deltas.BatchId(number, stream[0])
        # Several sinks read the batch; keep it instead of reading the source again.
        batch = batch.persist()
        try:
            given = before(batch, batch_id) if before else batch
            failures = {}
            for name, sink in sinks.items():
                try:
                    sink(given, batch_id)
                except Exception as error:  # the other sinks still run
                    failures[name] = error
            if failures:
                raise RuntimeError(f"sinks failed for batch {number}: {failures}")
        finally:
            batch.unpersist()

    return (
        rows.writeStream.foreachBatch(consume).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def run_progress(events: DataFrame, sinks: dict[str, Sink], checkpoint: str, *,
                 trigger: dict | None = None,
                 on_rejects: Callable[[int, dict], None] | None = None,
                 rejects: Sink | None = None) -> StreamingQuery:
    """Validate an event stream and hand the valid events of each micro-batch to every sink.

    `on_rejects` gets the numbers of valid and rejected events of a batch,
    `rejects` the rejected events with their reasons.
    """
    def validate(batch: DataFrame, batch_id: int) -> DataFrame:
        if on_rejects:
            counts = Observation()
            reason = progress.reject_reason()
            batch.observe(
                counts, F.count_if(reason.isNull()).alias("valid"),
                F.count_if(reason.isNotNull()).alias("rejected"),
            ).write.format("noop").mode("overwrite").save()
            on_rejects(batch_id, counts.get)
        if rejects:
            rejects(progress.event_rejects(batch), batch_id)
        return progress.valid_events(batch)

    return run_batches(events, sinks, checkpoint, trigger=trigger, before=validate)


def table_sink(path: str) -> Sink:
    """Every row as it is, a folder per batch."""
    return lambda rows, batch_id: deltas.write_batch(rows, path, batch_id)


# --- site statistics -------------------------------------------------------

SITE_DELTAS = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("site", T.StringType()),
    T.StructField("status_class", T.StringType()), T.StructField("visits", T.LongType()),
    T.StructField("bytes", T.LongType()), T.StructField("latest", T.TimestampNTZType()),
])


def site_stats_sink(path: str, fan: int = deltas.FAN) -> Sink:
    return lambda events, batch_id: deltas.add_batch(
        progress.site_deltas(events), path, batch_id, progress.add_deltas, SITE_DELTAS, fan)


def read_site_stats(spark: SparkSession, path: str) -> DataFrame:
    return progress.site_stats(deltas.read_batches(spark, path, SITE_DELTAS))


# --- job runs --------------------------------------------------------------

RUN_STARTS = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("started_at", T.TimestampNTZType()),
    T.StructField("first_start", T.LongType()), T.StructField("last_start", T.LongType()),
])
RUN_ENDS = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("end", T.StructType([
        T.StructField("ts", T.TimestampNTZType()), T.StructField("event_id", T.LongType()),
        T.StructField("stage", T.StringType()), T.StructField("note", T.StringType()),
    ])),
])


def job_runs_sink(path: str, fan: int = deltas.FAN) -> Sink:
    def sink(events: DataFrame, batch_id: int) -> None:
        deltas.add_batch(runs.run_starts(events), f"{path}/starts", batch_id, runs.add_starts, RUN_STARTS, fan)
        deltas.add_batch(runs.run_ends(events), f"{path}/ends", batch_id, runs.add_ends, RUN_ENDS, fan)
    return sink


def read_job_runs(spark: SparkSession, path: str) -> DataFrame:
    return runs.join_runs(
        runs.add_starts(deltas.read_batches(spark, f"{path}/starts", RUN_STARTS)),
        runs.add_ends(deltas.read_batches(spark, f"{path}/ends", RUN_ENDS)))


# --- running jobs ----------------------------------------------------------

MOVES = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("event_id", T.LongType()), T.StructField("stage", T.StringType()),
])


def running_jobs_sink(path: str, fan: int = deltas.FAN) -> Sink:
    """The starts and completions of a batch. What they do to the gauge depends
    on all events before them in time, so it is folded when read: batches may
    come in any order. Merges keep every one of them, in fewer files."""
    return lambda events, batch_id: deltas.add_batch(
        timeline.lifecycle(events), path, batch_id, lambda moves: moves.hint("rebalance"), MOVES, fan)


def read_running_jobs(spark: SparkSession, path: str) -> DataFrame:
    return timeline.running_jobs(deltas.read_batches(spark, path, MOVES))


def audit_sink(path: str) -> Sink:
    """Every event as a JSON log line."""
    return lambda events, batch_id: progress.audit_rows(events).write.mode("overwrite").json(
        deltas.folder(path, batch_id))


# --- rates -----------------------------------------------------------------

PAGE_COUNTS = T.StructType([
    T.StructField("window_start", T.TimestampNTZType()), T.StructField("site", T.StringType()),
    T.StructField("pages", T.LongType()),
])


def pages_rate_sink(path: str, fan: int = deltas.FAN) -> Sink:
    """Pages of a batch by window and site; rows may come late and windows need not close."""
    return lambda seen, batch_id: deltas.add_batch(
        metrics.pages_counted(seen), path, batch_id, add_page_counts, PAGE_COUNTS, fan)


def add_page_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("window_start", "site").agg(F.sum("pages").alias("pages"))


def read_pages_rate(spark: SparkSession, path: str) -> DataFrame:
    return metrics.rate_of_pages(deltas.read_batches(spark, path, PAGE_COUNTS))


def stream_pages_rate(observations: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Pages per second and site in five-minute windows, emitted once a window
    can no longer change. Rows later than `lateness` are dropped and the last
    windows stay open; `pages_rate_sink` loses neither."""
    from ..functions.urls import sanitize_site
    from ..operators.metrics import RATE_WINDOW

    return (
        observations.where(F.col("status") == "success")
        .withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", lateness)
        .groupBy(F.window("ts", f"{RATE_WINDOW} seconds").alias("w"),
                 sanitize_site(F.col("url")).alias("site"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "site",
                F.round(F.col("n") / RATE_WINDOW, 9).alias("pages_per_second"))
    )
