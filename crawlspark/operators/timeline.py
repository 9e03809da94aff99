"""Event timelines: running jobs and activity bursts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.times import micros
from . import slices


def lifecycle(events: DataFrame) -> DataFrame:
    """Starts and completions, the only events that move the running gauge."""
    return events.where(F.col("stage").isin(C.JOB_START, C.JOB_DONE, C.JOB_ERROR)).select(
        "job_id", "ts", "event_id", "stage")


def gauge_step(stage: Column, before: Column) -> Column:
    """+1 for a start of a job that is not running, -1 for a completion of one that is."""
    running = F.coalesce(before == C.JOB_START, F.lit(False))
    return (
        F.when((stage == C.JOB_START) & ~running, 1)
        .when((stage != C.JOB_START) & running, -1)
        .otherwise(0).cast("bigint")
    )


def gauge_deltas(events: DataFrame) -> DataFrame:
    """The events that change the set of running jobs, with their step."""
    stepped = slices.previous(lifecycle(events), ["job_id"], ["ts", "event_id"], "stage", "before")
    return stepped.select(
        "job_id", "ts", "event_id", gauge_step(F.col("stage"), F.col("before")).alias("step")
    ).where(F.col("step") != 0)


def running_jobs(events: DataFrame) -> DataFrame:
    """Number of running jobs after each step."""
    return slices.running_total(gauge_deltas(events), ["ts", "event_id"], "step", "running")


def activity_bursts(events: DataFrame, max_events: int = C.BATCH_MAX_EVENTS,
                    gap_ms: int = C.BATCH_MAX_WAIT_MS) -> DataFrame:
    """Events of a job grouped into bursts, closed by a quiet gap or by size.

    A row knows its burst from the number of the row that opened its stretch of
    activity. Where a job goes on in another partition, that number, the row
    count and the latest time are carried there.
    """
    keys, order = ["job_id"], ["ts", "event_id"]
    gap = F.lit(gap_ms * 1000).cast("bigint")
    rows = slices.ordered(
        events.select("job_id", "ts", "event_id", micros(F.col("ts")).alias("_at")), keys, order)
    inside = slices.inside(keys, order)
    local = rows.withColumns({
        "_n": F.row_number().over(inside).cast("bigint"), "_prev": F.lag("_at").over(inside)})
    local = local.withColumn("_opens", F.when(F.col("_at") - F.col("_prev") > gap, F.col("_n")))
    local = local.withColumn("_start", F.max("_opens").over(slices.running(keys, order)))

    before = slices.earlier(keys)
    parts = local.groupBy(slices.PART, *keys).agg(
        F.count(F.lit(1)).alias("_count"), F.min("_at").alias("_first"),
        F.max("_at").alias("_last"), F.max("_opens").alias("_opened"))
    parts = parts.withColumns({
        "_sum": F.coalesce(F.sum("_count").over(before), F.lit(0)),
        "_apart": F.coalesce(F.col("_first") - F.max("_last").over(before) > gap, F.lit(True)),
    })
    parts = parts.withColumn("_open", F.coalesce(
        F.col("_sum") + F.col("_opened"), F.when(F.col("_apart"), F.col("_sum") + 1)))
    coming = slices.carried(parts, keys, _before=F.col("_sum"), _fresh=F.col("_apart"),
                            _carried=F.max("_open").over(before))

    shift = F.coalesce("_before", F.lit(0))
    start = F.coalesce(
        shift + F.col("_start"),
        F.when(F.coalesce("_fresh", F.lit(True)), shift + 1), F.col("_carried"))
    number = shift + F.col("_n")
    place = number - start
    return (
        slices.carry(local, coming, keys)
        .select("job_id", "ts", "event_id", start.alias("_start"),
                F.floor(place / max_events).cast("bigint").alias("part"),
                (place % max_events == 0).alias("_leads"))
        .groupBy("job_id", "_start", "part").agg(
            F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
            F.max(F.when(F.col("_leads"), F.col("event_id"))).alias("first_event"),
            F.count(F.lit(1)).alias("events"))
        .drop("_start")
    )
