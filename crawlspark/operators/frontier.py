"""Frontier: which URLs of a job are fetched."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.urls import normalize_or_raw
from . import slices


def dedup_frontier(tasks: DataFrame) -> DataFrame:
    """One task per job and normalised URL: the first in order, with its repeats counted."""
    return tasks.withColumn("norm_url", normalize_or_raw(F.col("url"))).groupBy("job_id", "norm_url").agg(
        F.min("pos").alias("pos"), F.min_by("url", "pos").alias("url"),
        F.count(F.lit(1)).alias("copies"))


def filter_domains(tasks: DataFrame, allow: list[str] | Column, deny: list[str] | Column) -> DataFrame:
    """Tasks whose host is allowed. A rule matches the host and its subdomains;
    deny wins; an empty allow list allows all. A task without a host matches no rule."""
    host = F.lower(F.regexp_replace("host", r":[0-9]*$", ""))

    def matches(rules: list[str] | Column) -> Column:
        if isinstance(rules, Column):
            return F.coalesce(F.exists(
                rules, lambda r: (host == F.lower(r)) | host.endswith(F.concat(F.lit("."), F.lower(r)))),
                F.lit(False))
        tests = [(host == r.lower()) | host.endswith("." + r.lower()) for r in rules]
        return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))

    if isinstance(allow, Column):
        allowed = (F.coalesce(F.size(allow), F.lit(0)) <= 0) | matches(allow)
    else:
        allowed = matches(allow) if allow else F.lit(True)
    return tasks.where(allowed & ~matches(deny))


def filter_depth(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("depth") <= F.col("max_depth"))


def apply_policy(tasks: DataFrame, rules: DataFrame) -> DataFrame:
    """Policy answers per task; hosts without a rule are allowed. `rules` has
    one row per host."""
    return tasks.join(rules, "host", "left").withColumns({
        "fetch_allowed": F.coalesce("allow_fetch", F.lit(True)),
        "headless_allowed": F.coalesce("allow_headless", F.lit(True)),
    }).drop("allow_fetch", "allow_headless")


def cap_frontier(tasks: DataFrame) -> DataFrame:
    """Tasks within depth, `domain_cap` per job and host and `max_pages` per job,
    first come first kept. A NULL cap sets no limit."""
    ranked = slices.row_numbers(filter_depth(tasks), ["job_id", "host"], ["pos"], "host_rank")
    # A host can never place more than max_pages URLs, whatever its cap.
    within = ranked.where(
        F.col("host_rank") <= F.least(
            F.coalesce("domain_cap", F.lit((1 << 63) - 1)), F.coalesce("max_pages", F.lit((1 << 63) - 1))))
    return slices.row_numbers(within, ["job_id"], ["pos"], "job_rank").where(
        F.col("max_pages").isNull() | (F.col("job_rank") <= F.col("max_pages")))


def apply_budget(tasks: DataFrame, default_seconds: int = C.DEFAULT_BUDGET_SECONDS) -> DataFrame:
    """URLs run one after the other; those due after the budget is used up are skipped."""
    budget = F.when(F.coalesce("budget_seconds", F.lit(0)) > 0, F.col("budget_seconds")).otherwise(default_seconds)
    summed = slices.running_sum(tasks, ["job_id"], ["pos"], "dur_ms", "until_ms")
    started = F.col("until_ms") - F.col("dur_ms")
    return summed.select(
        "job_id", "pos", "url", started.alias("elapsed_ms"),
        F.when(started < budget * 1000, "fetched").otherwise("skipped").alias("decision"))
