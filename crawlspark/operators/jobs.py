"""Job submissions, job state and what became of a job's URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C

TERMINAL = ["succeeded", "failed", "canceled"]


# --- submissions -----------------------------------------------------------

def _or_default(column: str, default: int) -> Column:
    """Absent and zero both mean the default."""
    return F.coalesce(F.nullif(F.col(column), F.lit(0)), F.lit(default)).cast("bigint")


def resolve_params(
    submissions: DataFrame, *,
    max_depth: int = C.DEFAULT_MAX_DEPTH, max_pages: int = C.DEFAULT_MAX_PAGES,
    budget_seconds: int = C.DEFAULT_BUDGET_SECONDS, headless: bool = C.DEFAULT_HEADLESS,
    ignore_robots: bool = C.DEFAULT_IGNORE_ROBOTS,
) -> DataFrame:
    """Job requests with every parameter set.

    Flags count as given when they are not NULL, unless a `..._provided`
    column says otherwise: a flag set without being marked as provided is
    overridden by the configuration.
    """
    def flag(name: str, provided: str, default: bool) -> Column:
        given = F.col(name).isNotNull()
        if provided in submissions.columns:
            given = given & F.coalesce(F.col(provided), F.lit(False))
        return F.when(given, F.col(name)).otherwise(default)

    resolved = {
        "max_depth": _or_default("max_depth", max_depth),
        "max_pages": _or_default("max_pages", max_pages),
        "budget_seconds": _or_default("budget_seconds", budget_seconds),
        "headless_allowed": flag("headless_allowed", "headless_provided", headless),
        "respect_robots": flag("respect_robots", "respect_robots_provided", not ignore_robots),
        "headless_provided": F.lit(True),
        "respect_robots_provided": F.lit(True),
    }
    for name, kind in (("per_domain_caps", "map<string,int>"), ("tags", "map<string,string>")):
        if name in submissions.columns:
            entries = "array<struct<k:string,v:" + kind[11:-1] + ">>"
            empty = F.map_from_entries(F.array().cast(entries))
            resolved[name] = F.coalesce(F.col(name), empty)
    return submissions.where(F.size(F.coalesce("urls", F.array().cast("array<string>"))) > 0
                             ).withColumns(resolved)


def param_rejects(submissions: DataFrame) -> DataFrame:
    """Requests without URLs."""
    no_urls = F.size(F.coalesce("urls", F.array().cast("array<string>"))) == 0
    return submissions.where(no_urls).withColumn("reason", F.lit("urls required"))


def explode_tasks(jobs: DataFrame) -> DataFrame:
    """One row per URL of a job, in the order given."""
    return jobs.select(
        "job_id", "submitted_at", F.lit(1).cast("bigint").alias("attempt"),
        F.posexplode("urls").alias("pos", "url"),
    ).withColumn("pos", F.col("pos").cast("bigint"))


def templates_table(spark: SparkSession, templates: dict[str, dict]) -> DataFrame:
    """The configured job templates as a table; a handful of rows by nature."""
    schema = (
        "template string, urls array<string>, max_depth bigint, max_pages bigint,"
        "budget_seconds bigint, headless_allowed boolean, headless_provided boolean,"
        "respect_robots boolean, respect_robots_provided boolean"
    )
    names = [part.split()[0] for part in schema.split(",")]
    rows = [tuple({"template": t, **params}.get(n) for n in names) for t, params in templates.items()]
    return spark.createDataFrame(rows, schema)


def expand_templates(submissions: DataFrame, templates: DataFrame, **defaults) -> tuple[DataFrame, DataFrame]:
    """Jobs named after a template take its parameters; unknown names are returned apart."""
    named = submissions.where(F.col("template").isNotNull()).select("job_id", "submitted_at", "template")
    jobs = resolve_params(named.join(templates, "template"), **defaults)
    unknown = named.join(templates, "template", "left_anti").withColumn(
        "reason", F.lit("standard job template not found"))
    return jobs, unknown


def first_of_each(incoming: DataFrame) -> DataFrame:
    return incoming.groupBy("job_id").agg(F.min("seq").alias("seq"))


def new_jobs(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Creations that succeed: the first of each id that does not exist yet."""
    return first_of_each(incoming).join(existing.select("job_id").distinct(), "job_id", "left_anti")


def duplicate_jobs(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Creations refused because the job exists. Matching on id and sequence
    number spreads the repeats of one id over all tasks."""
    created = new_jobs(incoming, existing)
    return incoming.join(created, ["job_id", "seq"], "left_anti").select(
        "job_id", "seq", F.lit("job already exists").alias("reason"))


# --- state -----------------------------------------------------------------

def cancel_updates(cancels: DataFrame) -> DataFrame:
    """Cancel requests as status updates; they reset the counters."""
    return cancels.select(
        "job_id", "seq", "ts", F.lit("canceled").alias("status"),
        F.lit(C.CANCEL_ERROR).alias("error_text"),
        F.lit(0).cast("bigint").alias("pages_succeeded"),
        F.lit(0).cast("bigint").alias("pages_failed"))


def job_state(updates: DataFrame) -> DataFrame:
    """Jobs after all updates: the last one decides status, error and counters."""
    last = F.max_by(F.struct("status", "error_text", "pages_succeeded", "pages_failed"), F.col("seq"))
    folded = updates.groupBy("job_id").agg(
        F.min_by("ts", F.when(F.col("status") == "running", F.col("seq"))).alias("started_at"),
        F.max_by("ts", F.when(F.col("status").isin(TERMINAL), F.col("seq"))).alias("finished_at"),
        last.alias("last"))
    return folded.select("job_id", "started_at", "finished_at", "last.*")


def job_results(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """Jobs with their pages, a row per page; a job without pages has one row.

    An inner join plus the jobs without a match: both sides of an inner join
    can be split when one job holds much of the table, the page side of an
    outer join cannot.
    """
    with_pages = jobs.join(pages, "job_id")
    without = jobs.join(pages.select("job_id").distinct(), "job_id", "left_anti")
    return with_pages.unionByName(without, allowMissingColumns=True)


# --- outcomes --------------------------------------------------------------

def fold_attempts(attempts: DataFrame, max_retries: int = C.MAX_RETRIES) -> DataFrame:
    """Attempts per URL up to the first success, a context error or the limit."""
    n = F.col("attempt")
    # Numbers only in the aggregation, so that it can hash instead of sort.
    folded = attempts.where(n <= max_retries).groupBy("job_id", "pos", "url").agg(
        F.min(F.when(F.col("result") == "ok", n)).alias("ok"),
        F.min(F.when(F.col("result") == "ctx", n)).alias("ctx"), F.max(n).alias("latest"))
    never = F.lit(max_retries + 1)
    ok, ctx = F.coalesce("ok", never), F.coalesce("ctx", never)
    last = F.least(ok, ctx, F.col("latest"))
    return folded.select(
        "job_id", "pos", "url",
        F.when(ok < ctx, "success").when(ctx < ok, "canceled").otherwise("exhausted").alias("outcome"),
        (last + 1).cast("bigint").alias("attempts"), last.cast("bigint").alias("retries"))


def retry_waits(attempts: DataFrame, base_ms: int = C.RETRY_BASE_MS) -> DataFrame:
    """Planned wait before each attempt and the total so far.

    Attempt n waits n times the base, so the total is a triangular number:
    no window over the attempts is needed.
    """
    n = F.col("attempt").cast("bigint")
    return attempts.select(
        "job_id", "pos", "attempt", (n * base_ms).alias("wait_ms"),
        F.floor(n * (n + 1) / 2 * base_ms).cast("bigint").alias("total_wait_ms"))


def job_counters(outcomes: DataFrame) -> DataFrame:
    """Pages per job. URLs blocked by policy or refused by the rate limiter count as neither."""
    failed = F.col("outcome").isin("exhausted", "canceled", "persist_failed")
    return outcomes.groupBy("job_id").agg(
        F.count_if(F.col("outcome") == "success").alias("pages_succeeded"),
        F.count_if(failed).alias("pages_failed"))


def final_status(outcomes: DataFrame) -> DataFrame:
    """Status and error a job ends with; the last error in URL order is kept."""
    folded = outcomes.groupBy("job_id").agg(
        F.count_if(F.col("outcome") == "success").alias("pages_succeeded"),
        F.bool_or("job_ended").alias("ended"),
        F.max_by("error", F.when(F.coalesce("error", F.lit("")) != "", F.col("pos"))).alias("error"))
    none = F.col("pages_succeeded") == 0
    return folded.select(
        "job_id",
        F.when(F.col("ended"), "canceled").when(none, "failed").otherwise("succeeded").alias("status"),
        F.coalesce("error", F.when(none, C.NO_PAGES_ERROR), F.lit("")).alias("error_text"),
        "pages_succeeded")
