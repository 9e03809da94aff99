"""Progress events: validation, site statistics and the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C

SITE_KEYS = ["job_id", "site"]
SITE_COUNTERS = ["visits", "bytes_total"] + [f"fetch_{c}" for c in C.STATUS_CLASSES]


def _blank(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) == ""


def reject_reason() -> Column:
    """The first rule an event breaks; NULL for a valid event."""
    stage = F.col("stage")
    job_stage = stage.isin(C.JOB_START, C.JOB_HEARTBEAT, C.JOB_DONE, C.JOB_ERROR)
    return (
        F.when(_blank("job_id") | (F.col("job_id") == C.NIL_UUID), "job id is required")
        .when(F.col("ts").isNull(), "timestamp is required")
        .when((stage == C.FETCH_START) & _blank("site"), "fetch start requires site")
        .when((stage == C.FETCH_DONE) & _blank("site"), "fetch done requires site")
        .when((stage == C.FETCH_DONE) & _blank("status_class"), "fetch done requires status class")
        .when(~F.coalesce(job_stage | stage.isin(C.FETCH_START, C.FETCH_DONE), F.lit(False)),
              F.concat(F.lit('unknown stage "'), F.coalesce(stage, F.lit("")), F.lit('"')))
        .when(F.coalesce(F.col("dur_ms"), F.lit(0)) < 0, "duration must be >= 0")
    )


def valid_events(events: DataFrame) -> DataFrame:
    """Events that break no rule. The rules are spelled out one by one, not read
    off `reject_reason`, because simple conditions reach the Parquet scan."""
    stage = F.col("stage")
    fetch = stage.isin(C.FETCH_START, C.FETCH_DONE)
    return events.where(
        F.col("job_id").isNotNull() & ~F.col("job_id").isin("", C.NIL_UUID)
        & F.col("ts").isNotNull()
        & stage.isin(C.JOB_START, C.JOB_HEARTBEAT, C.JOB_DONE, C.JOB_ERROR, C.FETCH_START, C.FETCH_DONE)
        & (~fetch | ~_blank("site"))
        & ((stage != C.FETCH_DONE) | ~_blank("status_class"))
        & (F.col("dur_ms").isNull() | (F.col("dur_ms") >= 0)))


def event_rejects(events: DataFrame) -> DataFrame:
    return events.withColumn("reason", reject_reason()).where(F.col("reason").isNotNull())


def split_valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    return valid_events(events), event_rejects(events)


def foldable(events: DataFrame) -> DataFrame:
    """The stages that change stored tables."""
    return events.where(F.col("stage").isin(C.JOB_START, C.JOB_DONE, C.JOB_ERROR, C.FETCH_DONE))


def fetch_rows(events: DataFrame) -> DataFrame:
    """Completed fetches in the shape of site deltas, one row each."""
    done = events.where((F.col("stage") == C.FETCH_DONE) & ~_blank("site"))
    return done.select("job_id", "site", "status_class", "visits", "bytes", F.col("ts").alias("latest"))


def add_deltas(rows: DataFrame) -> DataFrame:
    """Visits, bytes and latest time per job, site and status class."""
    return rows.groupBy("job_id", "site", "status_class").agg(
        F.sum("visits").alias("visits"), F.sum("bytes").alias("bytes"),
        F.max("latest").alias("latest"))


def site_deltas(events: DataFrame) -> DataFrame:
    """Deltas of a batch of events. Those without visits and bytes are kept, as
    a later batch may add to them; `applied_deltas` drops what stays empty."""
    return add_deltas(fetch_rows(events))


def applied_deltas(deltas: DataFrame) -> DataFrame:
    return deltas.where((F.col("visits") != 0) | (F.col("bytes") != 0))


def site_delta_rejects(deltas: DataFrame) -> DataFrame:
    """Deltas of a class that site statistics have no counter for."""
    return applied_deltas(deltas).where(~F.col("status_class").isin(C.STATUS_CLASSES))


def site_stats(rows: DataFrame) -> DataFrame:
    """One row per job and site with a counter per class.

    Takes fetch rows or deltas of any number of batches. All classes are summed
    in one aggregation, so rows are shuffled once; classes that come to no
    visits and no bytes are left out afterwards.
    """
    known = rows.where(F.col("status_class").isin(C.STATUS_CLASSES))
    sums = []
    for c in C.STATUS_CLASSES:
        of_class = F.col("status_class") == c
        sums += [
            F.coalesce(F.sum(F.when(of_class, F.col("visits"))), F.lit(0)).alias(f"fetch_{c}"),
            F.coalesce(F.sum(F.when(of_class, F.col("bytes"))), F.lit(0)).alias(f"_bytes_{c}"),
            F.max(F.when(of_class, F.col("latest"))).alias(f"_latest_{c}"),
        ]
    counters = [F.col(f"fetch_{c}") for c in C.STATUS_CLASSES]
    sizes = [F.col(f"_bytes_{c}") for c in C.STATUS_CLASSES]
    latest = F.greatest(*[
        F.when((F.col(f"fetch_{c}") != 0) | (F.col(f"_bytes_{c}") != 0), F.col(f"_latest_{c}"))
        for c in C.STATUS_CLASSES])
    return known.groupBy(*SITE_KEYS).agg(*sums).select(
        *SITE_KEYS, latest.alias("last_update"), sum(counters[1:], counters[0]).alias("visits"),
        sum(sizes[1:], sizes[0]).alias("bytes_total"), *counters,
    ).where(F.col("last_update").isNotNull())


def add_site_stats(stats: DataFrame) -> DataFrame:
    """Statistics of any number of parts, one row per job and site."""
    return stats.groupBy(*SITE_KEYS).agg(
        F.max("last_update").alias("last_update"), *[F.sum(c).alias(c) for c in SITE_COUNTERS])


def merge_site_stats(target: DataFrame, deltas: DataFrame) -> DataFrame:
    """Existing statistics with new deltas added: updated where the row exists,
    inserted where it does not."""
    return add_site_stats(target.unionByName(site_stats(deltas)))


def audit_rows(events: DataFrame) -> DataFrame:
    """Every event as a log row."""
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("site", "url", "status_class", "note")]
    return events.select(
        "job_id", "stage", text[0], text[1], "bytes", "visits", text[2], "dur_ms", text[3])
