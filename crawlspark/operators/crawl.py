"""A crawl from submissions to retrieval rows, over the answers that fetchers have stored.

Submissions become tasks, tasks pass the policy by job, URL and depth, allowed tasks
meet their probe answers, answers are promoted where the job and the policy allow
it, and what is left is stored. Every task has one outcome; the steps are those of
the other modules, so their rules hold here too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from . import jobs, pages, rules

TASK = ["job_id", "pos"]


def gated_tasks(submissions: DataFrame, policy: DataFrame, depth: int = 0) -> DataFrame:
    """The tasks of submissions with what job and policy allow: `fetch_allowed`, `may_render`.

    URLs are normalised where they can be; the others keep their text. A URL that a
    job names twice is two tasks.
    """
    resolved = jobs.resolve_params(submissions)
    flags = resolved.select("job_id", F.col("headless_allowed").alias("job_renders"))
    tasks = jobs.explode_tasks(resolved).withColumn("url", urls.normalize_or_raw(F.col("url"))).withColumns({
        "host": urls.extract_host(F.col("url")), "depth": F.lit(depth).cast("bigint")})
    decided = rules.decide(tasks, policy)
    return decided.join(flags, "job_id").withColumn(
        "may_render", F.col("headless_allowed") & F.coalesce("job_renders", F.lit(False))).drop(
        "headless_allowed", "job_renders", "depth")


def answered(tasks: DataFrame, answers: DataFrame) -> DataFrame:
    """Allowed tasks with their probe answers (`job_id`, `pos` and a fetch response's columns), ready to be promoted."""
    own = tasks.where("fetch_allowed").select(
        *TASK, F.col("url").alias("asked_url"), F.col("submitted_at").alias("job_started_at"), "may_render")
    return answers.drop("job_started_at").join(own, TASK)


def crawl_results(submissions: DataFrame, answers: DataFrame, headless: DataFrame, policy: DataFrame,
                  **options) -> tuple[DataFrame, DataFrame]:
    """Stored pages of a crawl, and the outcome of every task: blocked, failed (no answer), or success."""
    tasks = gated_tasks(submissions, policy)
    probes = answered(tasks, answers)
    finals = pages.final_responses(probes, headless, allowed=F.col("may_render")).withColumn(
        "requested_url", F.col("asked_url"))
    stored = pages.stored_pages(finals, **options)
    found = probes.select(*TASK).distinct().withColumn("found", F.lit(True))
    outcomes = tasks.join(found, TASK, "left").select(
        *TASK, "url", F.when(~F.col("fetch_allowed"), "blocked").when(F.col("found"), "success")
        .otherwise("failed").alias("outcome"))
    return stored, outcomes
