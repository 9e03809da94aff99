"""The registered queries: every operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import content, status, times, urls
from ..operators import crawl, frontier, jobs, metrics, pages, progress, ratelimit, rules, runs, timeline
from ..session import new_run_dir
from ..sources import derived, schemas, tables
from ..stored import buckets, clustered
from ..stored.history import History
from ..streaming import outbox
from ..streaming import pages as page_stream
from ..streaming import progress as progress_stream
from ..streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    """Register a query under its function name. Times are computed in UTC."""
    @wraps(build)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        derived.crawl_events.cache_clear()
        return build(spark, folder)

    QUERIES[build.__name__] = run
    return run


def _valid(spark: SparkSession, folder: str) -> DataFrame:
    return progress.valid_events(derived.dirty_events(spark, folder))


def _deltas(spark: SparkSession, folder: str) -> DataFrame:
    return progress.site_deltas(_valid(spark, folder))


def _finals(spark: SparkSession, folder: str) -> DataFrame:
    return pages.final_responses(
        derived.fetches(spark, folder), derived.headless_fetches(spark, folder))


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    return pages.stored_pages(_finals(spark, folder))


# --- sources and sinks -----------------------------------------------------

@query
def scan_fetches(spark, folder):
    return derived.fetches(spark, folder).select(
        "fetch_id", "job_id", "url", "status_code", content.body_size(F.col("body")).alias("size"),
        "dur_ms", "fetched_at")


@query
def artifact_manifest(spark, folder):
    return pages.artifact_manifest(_stored(spark, folder))


@query
def artifact_round_trip(spark, folder):
    path = new_run_dir(spark, "artifacts")
    pages.write_artifacts(_finals(spark, folder), path)
    return pages.read_artifacts(spark, path).select(
        "id", "fetch_id", "job_id", "url", "headers", "meta", "blob_base", "yyyymm", "dd", "hh", "host",
        content.content_hash(F.col("body")).alias("body_hash"))


@query
def blob_uri(spark, folder):
    path = F.regexp_replace("url", "^https?:/", "")
    tricky = (
        F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("../.."), path))
        .when(F.col("page_id") % 5 == 1, F.concat(F.lit("a/../b"), path))
        .when(F.col("page_id") % 5 == 2, "").otherwise(F.substring(path, 2, 1 << 30)))
    return tables.pages(spark, folder).select("page_id", tricky.alias("path")).select(
        "page_id",
        urls.blob_uri(F.col("path"), "memory").alias("memory_uri"),
        urls.blob_uri(F.col("path"), "local", "/srv/blobs").alias("local_uri"),
        urls.blob_uri(F.col("path"), "gcs", "bucket").alias("gcs_uri"))


@query
def retrievals(spark, folder):
    return pages.retrievals(_stored(spark, folder)).drop("parent_id", "parent_ts")


@query
def notifications(spark, folder):
    return pages.notifications(_stored(spark, folder), "crawled-pages")


@query
def headers_json(spark, folder):
    return derived.fetches(spark, folder).select(
        "fetch_id", content.headers_json(F.col("headers")).alias("headers_json"))


@query
def meta_json(spark, folder):
    return pages.page_meta(_stored(spark, folder))


@query
def event_audit(spark, folder):
    return progress.audit_rows(_valid(spark, folder))


# --- expressions -----------------------------------------------------------

@query
def normalize_url(spark, folder):
    return derived.url_variants(spark, folder).select(
        "page_id", urls.normalize_url(F.col("raw_url")).alias("url"))


@query
def extract_host(spark, folder):
    return derived.url_variants(spark, folder).select(
        "page_id", urls.extract_host(F.col("raw_url")).alias("host"))


@query
def sanitize_host(spark, folder):
    return derived.url_variants(spark, folder).select(
        "page_id", urls.sanitize_host(urls.extract_host(F.col("raw_url"))).alias("host"))


@query
def sanitize_site(spark, folder):
    return derived.url_variants(spark, folder).select(
        "page_id", urls.sanitize_site(F.col("raw_url")).alias("site"))


@query
def limit_domain(spark, folder):
    return derived.url_variants(spark, folder).select(
        "page_id", urls.limit_domain(F.col("raw_url")).alias("domain"))


@query
def blob_base(spark, folder):
    rows = derived.fetches(spark, folder)
    base = urls.blob_base(
        F.col("fetched_at"), urls.extract_host(F.col("url")),
        F.concat(F.lit("page-"), F.col("fetch_id").cast("string")), "/crawl/")
    return rows.select("fetch_id", base.alias("blob_base"))


@query
def status_class(spark, folder):
    return derived.crawl_events(spark, folder).select(
        "event_id", status.status_class(F.col("status_code")).alias("status_class"))


@query
def content_hash(spark, folder):
    return derived.fetches(spark, folder).select(
        "fetch_id", content.content_hash(F.col("body")).alias("content_hash"))


@query
def content_type(spark, folder):
    return derived.fetches(spark, folder).select(
        "fetch_id", content.content_type(F.col("headers")).alias("content_type"))


@query
def script_coverage(spark, folder):
    return derived.fetches(spark, folder).select(
        "fetch_id", content.script_coverage(F.col("body")).alias("coverage"),
        content.script_dense(F.col("body")).alias("dense"))


@query
def should_promote(spark, folder):
    return derived.fetches(spark, folder).select(
        "fetch_id", content.should_promote(F.col("status_code"), F.col("body")).alias("promote"))


@query
def stage_of_status(spark, folder):
    stage = status.stage_of_status(F.col("status"))
    return derived.job_updates(spark, folder).unionByName(
        jobs.cancel_updates(derived.cancel_requests(spark, folder))).select(
        "seq", "status", F.coalesce(stage, F.lit("")).alias("stage"),
        F.coalesce(status.run_status_of_stage(stage), F.lit("")).alias("run_status"))


@query
def status_alias(spark, folder):
    names = ["running", " SUCCESS ", "Failed", "failure", "error", "bogus", ""]
    text = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 7 + 1).cast("int"))
    return tables.events(spark, folder).select(
        "event_id", F.coalesce(status.parse_status(text), F.lit("invalid")).alias("status"))


@query
def valid_job_ids(spark, folder):
    plain = derived.job_id_of(F.col("user_id"))
    n = F.col("event_id") % 7
    spelled = (
        F.when(n == 0, plain).when(n == 1, F.concat(F.lit("urn:uuid:"), plain))
        .when(n == 2, F.concat(F.lit("{"), plain, F.lit("}")))
        .when(n == 3, F.replace(plain, F.lit("-"), F.lit("")))
        .when(n == 4, F.lit(C.NIL_UUID)).when(n == 5, F.concat(F.lit("job-"), plain)).otherwise(""))
    return tables.events(spark, folder).select("event_id", spelled.alias("raw")).where(
        status.reports_progress(F.col("raw"))).select(
        "event_id", status.canonical_uuid(F.col("raw")).alias("job_id"))


@query
def time_ordered_id(spark, folder):
    return tables.events(spark, folder).select(
        "event_id", content.time_ordered_id(F.col("ts"), F.col("event_id")).alias("id"))


@query
def response_fallbacks(spark, folder):
    n = F.col("fetch_id") % 3
    captured = F.when(n == 0, F.col("url")).otherwise("")
    final = F.when(n == 1, F.concat("url", F.lit("/final")))
    code = F.when(n == 2, 0).otherwise(F.col("status_code"))
    return derived.fetches(spark, folder).select(
        "fetch_id",
        content.response_url(captured, final, F.concat("url", F.lit("/asked"))).alias("url"),
        content.response_status(code).alias("status_code"),
        content.headers_json(content.response_headers(F.col("headers"))).alias("headers"))


@query
def collect_headers(spark, folder):
    page = F.col("page_id")
    pair = lambda pos, name, value: F.struct(
        F.lit(pos).alias("pos"), F.lit(name).alias("name"), value.alias("value"))
    pairs = tables.pages(spark, folder).select(page.alias("response_id"), F.inline(F.array(
        pair(0, "set-cookie", F.concat(F.lit("a="), page.cast("string"))),
        pair(1, "content-length", content.body_size(F.col("html")).cast("string")),
        pair(2, "Set-Cookie", F.lit("b=1")),
        pair(3, "X-request-ID", F.sha2(F.col("url"), 256)),
    )))
    return pages.collect_headers(pairs).select(
        "response_id", content.headers_json(F.col("headers")).alias("headers"))


# --- events ----------------------------------------------------------------

@query
def valid_events(spark, folder):
    return _valid(spark, folder)


@query
def event_rejects(spark, folder):
    return progress.event_rejects(derived.dirty_events(spark, folder)).select("event_id", "reason")


@query
def site_deltas(spark, folder):
    return progress.applied_deltas(_deltas(spark, folder))


@query
def site_delta_rejects(spark, folder):
    return progress.site_delta_rejects(_deltas(spark, folder))


@query
def site_stats(spark, folder):
    return progress.site_stats(progress.fetch_rows(_valid(spark, folder)))


@query
def merge_site_stats(spark, folder):
    middle = F.lit("2024-01-16").cast("timestamp_ntz")
    events = _valid(spark, folder)
    old = progress.site_stats(progress.fetch_rows(events.where(F.col("ts") < middle)))
    return progress.merge_site_stats(old, progress.fetch_rows(events.where(F.col("ts") >= middle)))


@query
def job_runs(spark, folder):
    return runs.job_runs(_valid(spark, folder))


@query
def job_event_counts(spark, folder):
    return metrics.job_event_counts(_valid(spark, folder))


@query
def job_runtime_hist(spark, folder):
    return metrics.job_runtime_hist(_valid(spark, folder))


@query
def fetch_requests(spark, folder):
    return metrics.fetch_requests(derived.dirty_events(spark, folder))


@query
def fetch_bytes(spark, folder):
    return metrics.fetch_bytes(_valid(spark, folder))


@query
def fetch_duration_hist(spark, folder):
    return metrics.fetch_duration_hist(_valid(spark, folder))


@query
def running_jobs(spark, folder):
    return timeline.running_jobs(_valid(spark, folder))


@query
def activity_bursts(spark, folder):
    return timeline.activity_bursts(_valid(spark, folder), max_events=4, gap_ms=6 * 3600 * 1000)


# --- reads on runs and statistics -----------------------------------------

@query
def get_job(spark, folder):
    return runs.look_up_jobs(runs.job_runs(_valid(spark, folder)), derived.submissions(spark, folder))


@query
def list_jobs(spark, folder):
    return runs.list_jobs(runs.job_runs(_valid(spark, folder)), status="failed", limit=40, offset=10)


@query
def list_job_sites(spark, folder):
    return runs.list_job_sites(progress.site_stats(progress.fetch_rows(_valid(spark, folder)))).drop("rank")


@query
def top_sites_per_job(spark, folder):
    return runs.list_job_sites(progress.site_stats(progress.fetch_rows(_valid(spark, folder))), limit=3, offset=1)


@query
def job_dto(spark, folder):
    return runs.job_json(runs.job_runs(_valid(spark, folder)))


@query
def site_dto(spark, folder):
    return runs.site_json(progress.site_stats(progress.fetch_rows(_valid(spark, folder))))


@query
def list_pages(spark, folder):
    return pages.number_pages(derived.fetches(spark, folder).select(
        "job_id", "fetch_id", "url", "status_code", "fetched_at"))


# --- pages -----------------------------------------------------------------

@query
def final_responses(spark, folder):
    return _finals(spark, folder).select(
        "fetch_id", "job_id", "requested_url", "url", "status_code", "dur_ms", "used_headless",
        content.content_hash(F.col("body")).alias("content_hash"))


def _crawl(spark, folder):
    return crawl.crawl_results(
        derived.submissions(spark, folder), derived.answers(spark, folder),
        derived.headless_fetches(spark, folder), derived.policy(spark, folder))


@query
def crawl_results(spark, folder):
    """Retrieval rows from submissions on: tasks, policy, probes, promotion by job and policy, storage."""
    return pages.retrievals(_crawl(spark, folder)[0]).drop("parent_id", "parent_ts")


@query
def crawl_outcomes(spark, folder):
    return _crawl(spark, folder)[1]


@query
def scan_fetch_rows(spark, folder):
    """All columns of stored fetch responses: hash and size of the bytes, promotion by the text."""
    path = new_run_dir(spark, "fetch-rows")
    derived.fetch_rows_from(tables.pages(spark, folder)).write.parquet(path)
    rows = tables.fetch_rows(spark, path)
    text = pages.with_text(rows.select("fetch_id", "body")).select(
        "fetch_id", F.sha2(F.col("body").cast("binary"), 256).alias("text_hash"))
    return rows.select(
        "fetch_id", "url", content.body_size(F.col("body")).alias("size"),
        content.content_hash(F.col("body")).alias("content_hash"),
        F.octet_length("screenshot").cast("bigint").alias("screenshot_size"), "robots_status", "robots_reason").join(
        text, "fetch_id")


@query
def robots_warnings(spark, folder):
    return pages.robots_warnings(derived.fetch_rows_from(tables.pages(spark, folder)))


@query
def ensure_job_runs(spark, folder):
    started = derived.fetches(spark, folder)
    half = started.where(derived.job_number_of(F.col("job_id")) % 2 == 0).groupBy(
        "job_id", "job_started_at").agg(F.min("fetched_at").alias("finished_at"))
    known = runs.job_runs(_valid(spark, folder)).unionByName(half.select(
        F.col("job_id").alias("id"), "job_id", F.col("job_started_at").alias("started_at"), "finished_at",
        F.lit("success").alias("status"), F.lit(None).cast("string").alias("error_message")))
    return runs.ensure_job_runs(known, started)


@query
def job_result(spark, folder):
    state = jobs.job_state(derived.job_updates(spark, folder)).select("job_id", "status", "error_text")
    found = derived.fetches(spark, folder).select("job_id", "fetch_id", "url", "status_code")
    return jobs.job_results(state, found)


@query
def hash_dedup(spark, folder):
    return pages.dedup_by_hash(derived.fetches(spark, folder))


# --- jobs ------------------------------------------------------------------

TEMPLATES = {
    "price-refresh": {
        "urls": ["https://shop.example.com/", "https://shop.example.com/list"],
        "max_depth": 0, "max_pages": 60, "budget_seconds": 120,
        "headless_allowed": True, "headless_provided": False,
        "respect_robots": False, "respect_robots_provided": True,
    },
}


@query
def resolve_params(spark, folder):
    return jobs.resolve_params(derived.submissions(spark, folder)).select(
        "job_id", "max_depth", "max_pages", "budget_seconds", "headless_allowed", "respect_robots",
        F.size("urls").cast("bigint").alias("url_count"))


@query
def param_rejects(spark, folder):
    return jobs.param_rejects(derived.submissions(spark, folder)).select("job_id", "reason")


@query
def explode_tasks(spark, folder):
    return jobs.explode_tasks(jobs.resolve_params(derived.submissions(spark, folder)))


@query
def template_jobs(spark, folder):
    found, _ = jobs.expand_templates(
        derived.submissions(spark, folder), jobs.templates_table(spark, TEMPLATES))
    return found.select(
        "job_id", "template", "max_depth", "max_pages", "budget_seconds", "headless_allowed",
        "respect_robots", F.size("urls").cast("bigint").alias("url_count"))


@query
def template_rejects(spark, folder):
    _, unknown = jobs.expand_templates(
        derived.submissions(spark, folder), jobs.templates_table(spark, TEMPLATES))
    return unknown.select("job_id", "template", "reason")


def _creations(spark, folder):
    return derived.crawl_events(spark, folder).where(F.col("stage") == C.JOB_START).select(
        "job_id", F.col("event_id").alias("seq"))


@query
def new_jobs(spark, folder):
    return jobs.new_jobs(_creations(spark, folder), derived.fetches(spark, folder))


@query
def duplicate_jobs(spark, folder):
    return jobs.duplicate_jobs(_creations(spark, folder), derived.fetches(spark, folder))


@query
def job_state(spark, folder):
    cancels = jobs.cancel_updates(derived.cancel_requests(spark, folder))
    return jobs.job_state(derived.job_updates(spark, folder).unionByName(cancels))


@query
def fold_attempts(spark, folder):
    return jobs.fold_attempts(derived.attempts(spark, folder))


@query
def retry_waits(spark, folder):
    return jobs.retry_waits(derived.attempts(spark, folder))


@query
def job_counters(spark, folder):
    return jobs.job_counters(derived.outcomes(spark, folder))


@query
def final_status(spark, folder):
    return jobs.final_status(derived.outcomes(spark, folder))


# --- frontier and policy ---------------------------------------------------

@query
def dedup_frontier(spark, folder):
    return frontier.dedup_frontier(derived.tasks(spark, folder).select("job_id", "pos", "url"))


@query
def domain_filter(spark, folder):
    return frontier.filter_domains(
        derived.tasks(spark, folder), ["example.com", "EXAMPLE.org"], ["therou.example.com", "spam-farm.example.org"]
    ).select("job_id", "pos", "host")


@query
def policy_gate(spark, folder):
    host = F.col("host")
    rules = derived.crawl_events(spark, folder).select(F.col("site").alias("host")).distinct().where(
        ~host.startswith("m.")
    ).select("host", (F.length(host) % 3 != 0).alias("allow_fetch"),
             (F.length(host) % 2 == 0).alias("allow_headless"))
    return frontier.apply_policy(derived.tasks(spark, folder), rules).select(
        "job_id", "pos", "host", "fetch_allowed", "headless_allowed")


def _rules(spark, folder):
    """Many rules for every page: its site and the domains above, paths and depths, for all jobs and for single ones."""
    n = F.col("page_id")
    of_page = tables.pages(spark, folder).select(
        "page_id", F.regexp_extract("url", derived.HOST, 1).alias("site"), rules.path_of(F.col("url")).alias("path"),
        derived.job_id_of(n * 7 % 100).alias("job")).withColumn("above", F.regexp_replace("site", r"^[^.]*\.", ""))
    # a page is short here and gives 400 rules, so tasks get their share of pages and not of bytes
    spread = of_page.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    given = spread.select("*", F.explode(F.sequence(F.lit(0), F.lit(399))).alias("i")).select(
        F.when(F.col("i") % 3 == 1, F.col("job")).alias("job_id"),
        F.when(F.col("i") % 4 == 3, F.col("above")).otherwise(F.col("site")).alias("host"),
        F.when(F.col("i") < 2, "").when(F.col("i") < 4, F.col("path"))
        .otherwise(F.concat("path", F.lit("/r"), F.col("i").cast("string"))).alias("path"),
        F.when((n + F.col("i")) % 5 == 0, 1).cast("bigint").alias("min_depth"), F.lit(None).cast("bigint").alias("max_depth"),
        F.when((n + F.col("i")) % 41 == 0, 1).otherwise(0).alias("priority"),
        ((n + F.col("i")) % 3 != 0).alias("allow_fetch"), ((n * 3 + F.col("i")) % 4 != 0).alias("allow_headless"))
    return given


@query
def policy_rules(spark, folder):
    return rules.decide(derived.tasks(spark, folder).select("job_id", "pos", "url", "host", "depth"),
                        _rules(spark, folder))


@query
def cap_frontier(spark, folder):
    return frontier.cap_frontier(derived.tasks(spark, folder)).select(
        "job_id", "host", "pos", "host_rank", "job_rank")


@query
def job_budget(spark, folder):
    return frontier.apply_budget(derived.tasks(spark, folder)).drop("url")


def _schedule(spark, folder):
    asked = derived.tasks(spark, folder).select(
        "job_id", urls.limit_domain(F.col("url")).alias("domain"), F.col("pos").alias("seq"),
        times.micros(F.col("ts")).alias("arrival_us"))
    return ratelimit.rate_limit(asked, rate=1 / 3600, burst=2)


@query
def rate_limit_schedule(spark, folder):
    return _schedule(spark, folder)


@query
def rate_delay_hist(spark, folder):
    return metrics.rate_delay_hist(_schedule(spark, folder))


# --- counters and rates ----------------------------------------------------

@query
def pages_total(spark, folder):
    return metrics.pages_total(derived.attempts(spark, folder), derived.outcomes(spark, folder))


@query
def bytes_total(spark, folder):
    return metrics.bytes_total(derived.outcomes(spark, folder))


@query
def jobs_total(spark, folder):
    return metrics.jobs_total(jobs.final_status(derived.outcomes(spark, folder)))


@query
def http_requests(spark, folder):
    return metrics.http_requests(derived.requests(spark, folder))


@query
def http_latency_hist(spark, folder):
    return metrics.http_latency_hist(derived.requests(spark, folder))


@query
def robots_outcome(spark, folder):
    return metrics.robots_outcome(derived.robots_attempts(spark, folder))


@query
def tls_timeouts(spark, folder):
    return metrics.tls_timeouts(metrics.robots_outcome(derived.robots_attempts(spark, folder)))


@query
def pages_rate(spark, folder):
    return metrics.pages_rate(derived.observations(spark, folder))


@query
def pages_rate_sliding(spark, folder):
    return metrics.sliding_pages_rate(derived.observations(spark, folder))


@query
def error_ratio(spark, folder):
    return metrics.error_ratio(derived.observations(spark, folder))


@query
def latency_p95(spark, folder):
    return metrics.latency_p95(derived.requests(spark, folder))


@query
def bytes_rate(spark, folder):
    return metrics.bytes_rate(derived.observations(spark, folder))


# --- stored tables -----------------------------------------------------------

# What earlier runs stored is here a part of the given rows, written first; the rest comes in.

@query
def new_frontier(spark, folder):
    """Tasks whose URL no earlier run of the job has had."""
    given = derived.tasks(spark, folder).select("job_id", "pos", "url")
    history = History(spark, new_run_dir(spark, "frontier"), {"job_id": "string", "norm_url": "string"})
    history.add(frontier.dedup_frontier(given.where(F.col("pos") % 2 == 0)))
    return history.new(frontier.dedup_frontier(given.where(F.col("pos") % 2 == 1)))


@query
def new_bodies(spark, folder):
    """Bodies that no earlier run has stored."""
    given = derived.fetches(spark, folder)
    history = History(spark, new_run_dir(spark, "bodies"), {"content_hash": "string"})
    history.add(pages.dedup_by_hash(given.where(F.col("fetch_id") % 3 == 0)))
    return history.new(pages.dedup_by_hash(given.where(F.col("fetch_id") % 3 != 0)))


@query
def repeated_jobs(spark, folder):
    """Creations of jobs that exist."""
    given = _creations(spark, folder)
    history = History(spark, new_run_dir(spark, "jobs"), {"job_id": "string"})
    history.add(given.where(F.col("seq") % 2 == 0))
    return history.known(given.where(F.col("seq") % 2 == 1))


def _thirds(spark, folder):
    valid = _valid(spark, folder)
    return [valid.where(F.col("event_id") % 3 == i) for i in (2, 0, 1)]


@query
def stored_job_runs(spark, folder):
    """Runs after three upserts, the last of which comes with events between those of the others."""
    table = buckets.job_runs_table(spark, new_run_dir(spark, "stored-runs"), 16)
    for part in _thirds(spark, folder):
        table.upsert(buckets.run_facts(part))
    return buckets.read_job_runs(table)


@query
def stored_site_stats(spark, folder):
    table = buckets.site_stats_table(spark, new_run_dir(spark, "stored-sites"), 16)
    for part in _thirds(spark, folder):
        table.upsert(progress.site_stats(progress.fetch_rows(part)))
    return table.read()


#: The job that point reads look for.
ONE_JOB = derived.JOB_PREFIX + "000000000007"


@query
def get_stored_job(spark, folder):
    table = clustered.runs_by_id(spark, new_run_dir(spark, "runs-by-id"))
    table.write(runs.job_runs(_valid(spark, folder)))
    return runs.get_job(table.point(ONE_JOB), ONE_JOB)


@query
def newest_jobs(spark, folder):
    table = clustered.runs_by_time(spark, new_run_dir(spark, "runs-by-time"))
    table.write(runs.job_runs(_valid(spark, folder)))
    return table.newest(40, 10, ["id"], F.col("status") == "error", share=0.2)


@query
def stored_job_sites(spark, folder):
    table = clustered.sites_by_job(spark, new_run_dir(spark, "sites-by-job"))
    table.write(progress.site_stats(progress.fetch_rows(_valid(spark, folder))))
    return runs.list_job_sites(table.point(ONE_JOB), ONE_JOB, limit=200, offset=1)


# --- streams ---------------------------------------------------------------

# Every stream reads its table in several files of shared storage, a file per batch and
# not in the order of time, so that folds over batches are put to the test.

STREAM_FILES = 4


def _files(spark, folder, name, schema, key):
    """A given table as a stream of files, dealt by a hash of its key."""
    path = new_run_dir(spark, f"{name}-files")
    tables_of = {"events": tables.events, "pages": tables.pages}
    tables_of[name](spark, folder).repartition(STREAM_FILES, F.xxhash64(key)).write.parquet(path)
    return tables.stream(spark, schema, path, files_per_trigger=1)


def _event_stream(spark, folder):
    """Events as a stream, joined with the static pages."""
    rows = _files(spark, folder, "events", schemas.EVENTS, "event_id")
    return derived.progress_from(rows, tables.pages(spark, folder))


def _run(stream_query):
    stream_query.awaitTermination()


def _progress(spark, folder, name, sink):
    path = new_run_dir(spark, name)
    _run(progress_stream.run_progress(
        derived.dirty_from(_event_stream(spark, folder)), {name: sink(f"{path}/out")}, f"{path}/checkpoint"))
    return f"{path}/out"


@query
def stream_site_stats(spark, folder):
    out = _progress(spark, folder, "site-stats", progress_stream.site_stats_sink)
    return progress_stream.read_site_stats(spark, out)


@query
def stream_job_runs(spark, folder):
    out = _progress(spark, folder, "job-runs", progress_stream.job_runs_sink)
    return progress_stream.read_job_runs(spark, out)


@query
def stream_running_jobs(spark, folder):
    out = _progress(spark, folder, "running-jobs", progress_stream.running_jobs_sink)
    return progress_stream.read_running_jobs(spark, out)


@query
def stream_pages_rate(spark, folder):
    path = new_run_dir(spark, "pages-rate")
    seen = derived.observations_from(_event_stream(spark, folder))
    _run(progress_stream.run_batches(
        seen, {"rates": progress_stream.pages_rate_sink(f"{path}/out")}, f"{path}/checkpoint"))
    return progress_stream.read_pages_rate(spark, f"{path}/out")


@query
def stream_closing_rates(spark, folder):
    """Rates whose windows close as the stream goes on, with what came late and what is still open."""
    path = new_run_dir(spark, "closing-rates")
    rates = windows.ClosingRates(spark, f"{path}/out")
    _run(progress_stream.run_batches(
        derived.observations_from(_event_stream(spark, folder)), {"rates": rates.sink()}, f"{path}/checkpoint"))
    return rates.all()


def _page_stream(spark, folder):
    return derived.fetches_from(_files(spark, folder, "pages", schemas.PAGES, "page_id"))


@query
def stream_retrievals(spark, folder):
    path = new_run_dir(spark, "retrievals")
    _run(page_stream.stream_retrievals(_page_stream(spark, folder), f"{path}/out", f"{path}/checkpoint"))
    return tables.retrievals(spark, f"{path}/out")


@query
def stream_notifications(spark, folder):
    path = new_run_dir(spark, "messages")
    _run(page_stream.stream_notifications(
        _page_stream(spark, folder), "crawled-pages", f"{path}/checkpoint", path=f"{path}/out"))
    return spark.read.schema("value string").text(f"{path}/out")


@query
def stream_outbox(spark, folder):
    """Messages that a consumer counts, each with the retrieval row that it tells of."""
    path = new_run_dir(spark, "outbox")
    box = outbox.Outbox(spark, f"{path}/table", "crawled-pages")
    sender = lambda messages, stream, number: messages.write.mode("append").parquet(f"{path}/sent")
    _run(outbox.stream_crawl(_page_stream(spark, folder), box, sender, f"{path}/checkpoint"))
    sent = outbox.first_deliveries(spark.read.schema("id string, value string").parquet(f"{path}/sent"))
    return sent.join(box.retrievals().select("id", "retrieval_url", "retrieval_hashcode"), "id")
