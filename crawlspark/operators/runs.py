"""Job runs: the history of starts and completions, and reads on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import times
from ..functions.status import parse_status, run_status_of_stage
from ..functions.times import rfc3339
from . import slices

RUN_COLUMNS = ["id", "job_id", "started_at", "finished_at", "status", "error_message"]


def run_starts(events: DataFrame) -> DataFrame:
    """First and last start event of each run. A run is a job and a start time."""
    return (
        events.where(F.col("stage") == C.JOB_START)
        .groupBy("job_id", F.col("ts").alias("started_at"))
        .agg(F.min("event_id").alias("first_start"), F.max("event_id").alias("last_start"))
    )


def run_ends(events: DataFrame) -> DataFrame:
    """Last completion of each job."""
    ends = events.where(F.col("stage").isin(C.JOB_DONE, C.JOB_ERROR))
    return ends.groupBy("job_id").agg(
        F.max_by(F.struct("ts", "event_id", "stage", "note"), F.struct("ts", "event_id")).alias("end"))


def add_starts(starts: DataFrame) -> DataFrame:
    return starts.groupBy("job_id", "started_at").agg(
        F.min("first_start").alias("first_start"), F.max("last_start").alias("last_start"))


def add_ends(ends: DataFrame) -> DataFrame:
    return ends.groupBy("job_id").agg(F.max_by("end", F.struct("end.ts", "end.event_id")).alias("end"))


def join_runs(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Runs with the completion that reached them.

    A completion sets every run of its job that exists by then, so the last one
    decides, and it reaches a run if it follows the first start. A start event
    repeated after it sets the run back to running but keeps the rest.
    """
    end = F.col("end")
    end_at = F.struct(end["ts"], end["event_id"])
    reached = end_at > F.struct("started_at", "first_start")
    restarted = F.struct("started_at", "last_start") > end_at
    done = reached & ~restarted
    return starts.join(ends, "job_id", "left").select(
        F.col("job_id").alias("id"), "job_id", "started_at",
        F.when(reached, end["ts"]).alias("finished_at"),
        F.when(done, run_status_of_stage(end["stage"])).otherwise("running").alias("status"),
        F.when(reached & (end["stage"] == C.JOB_ERROR),
               F.nullif(end["note"], F.lit(""))).alias("error_message"),
    )


def job_runs(events: DataFrame) -> DataFrame:
    """Runs after all events; events apply in the order of `ts`, then `event_id`."""
    return join_runs(run_starts(events), run_ends(events))


def ensure_job_runs(runs: DataFrame, retrievals: DataFrame) -> DataFrame:
    """Runs, and a running one for each retrieval whose run is missing."""
    needed = (
        retrievals.where((F.coalesce("job_id", F.lit("")) != "") & F.col("job_started_at").isNotNull())
        .groupBy(F.col("job_id").alias("id"), F.col("job_started_at").alias("started_at")).agg(
            F.count(F.lit(1)).alias("pages"))
    )
    missing = needed.join(runs.select("id", "started_at"), ["id", "started_at"], "left_anti")
    return runs.select(*RUN_COLUMNS).unionByName(missing.select(
        "id", F.col("id").alias("job_id"), "started_at",
        F.lit(None).cast("timestamp_ntz").alias("finished_at"),
        F.lit("running").alias("status"), F.lit(None).cast("string").alias("error_message")))


def get_job(runs: DataFrame, job_id: str) -> DataFrame:
    """Runs of one id; the filter reaches the scan of a stored table."""
    return runs.where(F.col("id") == job_id)


def look_up_jobs(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Runs of each wanted id; an id without any is returned as not found."""
    ids = wanted.select(F.col("job_id").alias("id")).distinct()
    found = runs.join(ids, "id").select(*RUN_COLUMNS, F.lit(True).alias("found"))
    missing = ids.join(runs.select("id").distinct(), "id", "left_anti")
    return found.unionByName(
        missing.withColumn("found", F.lit(False)), allowMissingColumns=True)


def _page(limit: int | None, offset: int, default: int, largest: int) -> tuple[int, int]:
    limit = default if limit is None else limit
    if limit <= 0:
        raise ValueError("invalid limit")
    if offset < 0:
        raise ValueError("invalid offset")
    return min(limit, largest), offset


def list_jobs(runs: DataFrame, status: str | None = None, limit: int | None = None,
              offset: int = 0) -> DataFrame:
    """Runs, newest first; one page of them."""
    limit, offset = _page(limit, offset, C.JOBS_LIMIT, C.JOBS_LIMIT_MAX)
    if status is not None and status.strip():
        if status.strip().lower() not in ("running", "success", "error", "failed", "failure"):
            raise ValueError("invalid status")
        runs = runs.where(F.col("status") == parse_status(F.lit(status)))
    return runs.orderBy(F.desc("started_at"), "id").offset(offset).limit(limit)


def list_job_sites(stats: DataFrame, job_id: str | None = None, limit: int | None = None,
                   offset: int = 0) -> DataFrame:
    """Site statistics of a job, latest update first; of every job if none is named.

    A page of one job has a default and a largest size. Over all jobs every site
    is listed unless a limit is given; then the rank filter also runs before the
    shuffle, so a job with many sites sends no more than one page per task.
    """
    latest = [F.desc("last_update"), F.asc("site")]
    if job_id is not None:
        limit, offset = _page(limit, offset, C.SITES_LIMIT, C.SITES_LIMIT_MAX)
        return stats.where(F.col("job_id") == job_id).orderBy(*latest).offset(offset).limit(limit)
    _page(limit, offset, C.SITES_LIMIT, C.SITES_LIMIT_MAX)  # refuses what is not a limit or an offset
    if limit is None:
        keyed = stats.withColumn("_back", -times.micros(F.col("last_update")))
        return slices.row_numbers(keyed, ["job_id"], ["_back", "site"], "rank").drop("_back").where(
            F.col("rank") > offset).withColumn("rank", F.col("rank").cast("int"))
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy(*latest))
    return (
        stats.withColumn("rank", rank).where(F.col("rank") <= offset + limit)
        .where(F.col("rank") > offset)
    )


def job_json(runs: DataFrame) -> DataFrame:
    """Run documents; absent times and errors are left out."""
    document = F.struct(
        F.col("id"), F.col("job_id"), rfc3339(F.col("started_at")).alias("started_at"),
        rfc3339(F.col("finished_at")).alias("finished_at"), F.col("status"),
        F.col("error_message").alias("error"))
    return runs.select("id", "started_at", F.to_json(document).alias("job"))


def site_json(stats: DataFrame) -> DataFrame:
    """Site documents, without the job id."""
    document = F.struct(
        F.col("site"), rfc3339(F.col("last_update")).alias("last_update"), F.col("visits"),
        F.col("bytes_total"), *[F.col(f"fetch_{c}") for c in C.STATUS_CLASSES])
    return stats.select("job_id", F.to_json(document).alias("site_stats"))
