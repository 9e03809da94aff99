"""Counters, histograms and rates over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.times import window_start
from ..functions.urls import crawl_site, sanitize_site

RATE_WINDOW = 300  # seconds


# --- counters --------------------------------------------------------------

def pages_total(attempts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Pages per site and status: failed attempts and failed writes are errors."""
    failed = attempts.where(F.col("result") != "ok").select("url", F.lit("error").alias("status"))
    ended = outcomes.where(F.col("outcome").isin("success", "persist_failed")).select(
        "url", F.when(F.col("outcome") == "success", "success").otherwise("error").alias("status"))
    return failed.unionByName(ended).groupBy(crawl_site(F.col("url")).alias("site"), "status").agg(
        F.count(F.lit(1)).alias("pages"))


def bytes_total(outcomes: DataFrame) -> DataFrame:
    """Bytes per site of pages fetched, written or not."""
    fetched = outcomes.where(
        F.col("outcome").isin("success", "persist_failed") & (F.col("bytes") > 0))
    return fetched.groupBy(crawl_site(F.col("url")).alias("site")).agg(F.sum("bytes").alias("bytes"))


def jobs_total(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("jobs"))


def job_event_counts(events: DataFrame) -> DataFrame:
    """Jobs started and completed; every event counts, repeats included."""
    name = (
        F.when(F.col("stage") == C.JOB_START, "started")
        .when(F.col("stage") == C.JOB_DONE, "success")
        .when(F.col("stage") == C.JOB_ERROR, "error")
    )
    return events.withColumn("counter", name).where(F.col("counter").isNotNull()).groupBy(
        "counter").agg(F.count(F.lit(1)).alias("value"))


def fetch_labels(events: DataFrame) -> DataFrame:
    """Completed fetches with the labels their metrics carry."""
    def label(name: str, fallback: str) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(fallback))

    return events.where(F.col("stage") == C.FETCH_DONE).withColumns({
        "site": label("site", C.UNKNOWN), "status_class": label("status_class", C.OTHER_CLASS)})


def fetch_requests(events: DataFrame) -> DataFrame:
    return fetch_labels(events).groupBy("site", "status_class").agg(F.count(F.lit(1)).alias("requests"))


def fetch_bytes(events: DataFrame) -> DataFrame:
    return fetch_labels(events).where(F.col("bytes") > 0).groupBy("site").agg(
        F.sum("bytes").alias("bytes"))


def http_requests(log: DataFrame) -> DataFrame:
    return log.groupBy("method", F.col("code").cast("string").alias("code")).agg(
        F.count(F.lit(1)).alias("requests"))


# --- histograms ------------------------------------------------------------

def _bound(value: float) -> str:
    return f"{value:g}"


def histogram(df: DataFrame, seconds: Column, bounds: list[float], by: list[str],
              total: Column | None = None) -> DataFrame:
    """Cumulative histogram per label set: a row per bound and one for `+Inf`.

    All bounds are counted in one aggregation; only its result is unfolded.
    `total` may give the sum of seconds from whole units, which don't depend on
    the order of adding; otherwise seconds are summed as decimals.
    """
    total = F.sum(seconds.cast("decimal(20,9)")).cast("double") if total is None else total
    counted = df.groupBy(*by).agg(
        *[F.count_if(seconds <= b).alias(f"_le{i}") for i, b in enumerate(bounds)],
        F.count(F.lit(1)).alias("observations"), F.round(total, 4).alias("sum_seconds"))
    buckets = [
        F.struct(F.lit(_bound(b)).alias("le"), F.col(f"_le{i}").alias("bucket_count"))
        for i, b in enumerate(bounds)
    ] + [F.struct(F.lit("+Inf").alias("le"), F.col("observations").alias("bucket_count"))]
    return counted.select(
        *by, "observations", "sum_seconds", F.inline(F.array(*buckets)))


def job_runtime_hist(events: DataFrame) -> DataFrame:
    result = F.when(F.col("stage") == C.JOB_DONE, "success").when(F.col("stage") == C.JOB_ERROR, "error")
    ended = events.withColumn("result", result).where(F.col("result").isNotNull() & (F.col("dur_ms") > 0))
    return histogram(ended, F.col("dur_ms") / 1000.0, C.JOB_RUNTIME_BOUNDS, ["result"],
                     F.sum("dur_ms") / 1000.0)


def fetch_duration_hist(events: DataFrame) -> DataFrame:
    done = fetch_labels(events).where(F.col("dur_ms") > 0)
    return histogram(done, F.col("dur_ms") / 1000.0, C.FETCH_DURATION_BOUNDS, ["site", "status_class"],
                     F.sum("dur_ms") / 1000.0)


def with_route(log: DataFrame) -> DataFrame:
    return log.withColumn("route", F.coalesce(F.nullif(F.col("route"), F.lit("")), F.lit(C.UNKNOWN)))


def http_latency_hist(log: DataFrame) -> DataFrame:
    return histogram(with_route(log), F.col("dur_s"), C.HTTP_LATENCY_BOUNDS, ["method", "route"])


def rate_delay_hist(schedule: DataFrame) -> DataFrame:
    """Waits of more than a millisecond caused by the rate limiter. In a long queue they grow with its length, so
    their sum may be beyond a bigint and is taken as decimals."""
    waited = schedule.where(F.col("delay_us") > 1000)
    return histogram(waited, F.col("delay_us") / 1e6, C.RATE_DELAY_BOUNDS, ["domain"],
                     F.sum(F.col("delay_us").cast("decimal(19,0)")).cast("double") / 1e6)


def quantile_from_buckets(df: DataFrame, seconds: Column, bounds: list[float], by: list[str],
                          q: float, name: str) -> DataFrame:
    """Quantile read off a histogram, linear inside the bucket that holds it.

    The lowest bucket starts at 0; beyond the highest bound the bound is returned.
    """
    counts = df.groupBy(*by).agg(
        *[F.count_if(seconds <= b).alias(f"_le{i}") for i, b in enumerate(bounds)],
        F.count(F.lit(1)).alias("observations"))
    rank = F.col("observations") * q
    value = F.lit(None).cast("double")
    for i, upper in enumerate(bounds):
        lower = bounds[i - 1] if i else 0
        below = F.col(f"_le{i - 1}") if i else F.lit(0)
        inside = (rank - below) / F.nullif(F.col(f"_le{i}") - below, F.lit(0))
        reached = (F.col(f"_le{i}") >= rank) & (below < rank)
        value = F.when(reached, lower + (upper - lower) * inside).otherwise(value)
    value = F.coalesce(value, F.lit(float(bounds[-1])))
    return counts.select(*by, "observations", F.round(value, 6).alias(name))


# --- rates over time -------------------------------------------------------

def _windowed(df: DataFrame) -> DataFrame:
    return df.withColumn("window_start", window_start(F.col("ts"), RATE_WINDOW))


def pages_counted(observations: DataFrame) -> DataFrame:
    """Pages by site and window of five minutes, successes only."""
    succeeded = _windowed(observations.where(F.col("status") == "success"))
    return succeeded.groupBy("window_start", sanitize_site(F.col("url")).alias("site")).agg(
        F.count(F.lit(1)).alias("pages"))


def rate_of_pages(counts: DataFrame) -> DataFrame:
    """Pages per second from such counts, which may come in parts."""
    return counts.groupBy("window_start", "site").agg(
        F.round(F.sum("pages") / RATE_WINDOW, 9).alias("pages_per_second"))


def pages_rate(observations: DataFrame) -> DataFrame:
    """Pages per second and site over five minutes, successes only."""
    return pages_counted(observations).select(
        "window_start", "site", F.round(F.col("pages") / RATE_WINDOW, 9).alias("pages_per_second"))


def sliding_pages_rate(observations: DataFrame, step: int = 60) -> DataFrame:
    """As `pages_rate`, with a window ending at every `step` seconds.

    Rows are first counted per step; only those counts are copied into the
    windows that hold them.
    """
    per_step = (
        observations.where(F.col("status") == "success")
        .withColumn("step_start", window_start(F.col("ts"), step))
        .groupBy("step_start", sanitize_site(F.col("url")).alias("site")).agg(F.count(F.lit(1)).alias("n"))
    )
    back = F.sequence(F.lit(0), F.lit(RATE_WINDOW - step), F.lit(step))
    copies = per_step.select("site", "n", "step_start", F.explode(back).alias("back")).select(
        "site", "n",
        F.timestamp_add("SECOND", -F.col("back"), F.col("step_start")).alias("window_start"))
    return copies.groupBy("window_start", "site").agg(
        F.round(F.sum("n") / RATE_WINDOW, 9).alias("pages_per_second"))


def error_ratio(observations: DataFrame) -> DataFrame:
    """Share of failed pages over five minutes."""
    return _windowed(observations).groupBy("window_start").agg(
        F.round(F.count_if(F.col("status") == "error") / F.count(F.lit(1)), 9).alias("error_ratio"))


def latency_p95(log: DataFrame) -> DataFrame:
    """95th percentile of request latency over five minutes."""
    return quantile_from_buckets(
        _windowed(log), F.col("dur_s"), C.HTTP_LATENCY_BOUNDS, ["window_start"], 0.95, "p95_seconds")


def bytes_rate(observations: DataFrame) -> DataFrame:
    """Bytes per second and site over five minutes."""
    fetched = _windowed(observations.where(F.col("bytes") > 0))
    return fetched.groupBy("window_start", sanitize_site(F.col("url")).alias("site")).agg(
        F.round(F.sum("bytes") / RATE_WINDOW, 6).alias("bytes_per_second"))


# --- robots.txt ------------------------------------------------------------

def robots_outcome(attempts: DataFrame) -> DataFrame:
    """What reading robots.txt of each site came to.

    Time-outs are retried after set pauses; when all attempts time out the
    answer stays open and the crawl goes on as if everything were allowed.
    """
    limit = len(C.ROBOTS_BACKOFF_MS)
    n = F.col("attempt")
    folded = attempts.where(n <= limit).groupBy("site").agg(
        F.min(F.when(F.col("result") == "ok", n)).alias("ok"),
        F.min(F.when(F.col("result") == "fatal", n)).alias("fatal"), F.max(n).alias("latest"))
    ok, fatal = F.coalesce("ok", F.lit(limit + 1)), F.coalesce("fatal", F.lit(limit + 1))
    last = F.least(ok, fatal, F.col("latest"))
    open_end = (ok == fatal) & (F.col("latest") == limit)
    pauses = F.array(*[F.lit(sum(C.ROBOTS_BACKOFF_MS[:i])) for i in range(limit + 1)])
    return folded.select(
        "site",
        F.when(ok < fatal, "fetched").when(fatal < ok, "failed")
        .when(open_end, "indeterminate").otherwise("pending").alias("outcome"),
        F.when(open_end, C.ROBOTS_INDETERMINATE_REASON).otherwise("").alias("reason"),
        ((ok < fatal) | open_end).alias("may_fetch"),
        (last + 1).cast("bigint").alias("attempts"),
        F.element_at(pauses, last + 1).cast("bigint").alias("waited_ms"))


def tls_timeouts(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(F.count_if(F.col("outcome") == "indeterminate").alias("timeouts"))
