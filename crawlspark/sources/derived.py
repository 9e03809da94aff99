"""Crawl tables derived from the given `pages` and `events` tables.

They give every operator whole-table input with the shapes a crawl produces.
`FIXTURES.md` states the rules.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import content
from . import tables

JOB_PREFIX = "00000000-0000-7000-8000-"
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)"


def job_id_of(number: Column) -> Column:
    return F.concat(F.lit(JOB_PREFIX), F.lpad(number.cast("string"), 12, "0"))


def job_number_of(job_id: Column) -> Column:
    return F.substring(job_id, -12, 12).cast("bigint")


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _with_k(events: DataFrame) -> DataFrame:
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def progress_from(events: DataFrame, pages: DataFrame) -> DataFrame:
    """Progress events: one per event row, about the page its id points at."""
    # Only the size of a page travels through the join, never its text.
    sized = pages.select("page_id", "url", content.body_size(F.col("html")).alias("size"))
    k = F.col("k")
    stage = (
        F.when(F.col("event_type") == "signup", "JOB_START")
        .when(F.col("event_type") == "purchase",
              F.when(k % 10 == 9, "JOB_CANCELED").otherwise("JOB_DONE"))
        .when(F.col("event_type") == "error",
              F.when(k < 60, "JOB_ERROR").when(k < 80, "JOB_HEARTBEAT").otherwise("FETCH_START"))
        .otherwise("FETCH_DONE")
    )
    staged = _with_k(events).select(
        "event_id", "k", job_id_of(F.col("user_id")).alias("job_id"), "ts",
        stage.alias("stage"), "value",
        (F.col("event_id") % pages.agg(F.count(F.lit(1))).scalar()).alias("page_id"),
    # Counting rows here also keeps conditions on these columns above this
    # point, so that the JSON text is read once per row, not in each of them.
    ).observe("staged_events", F.count(F.lit(1)).alias("rows"))
    done = F.col("stage") == "FETCH_DONE"
    counted = done & (k != 55)
    code = F.element_at(F.array(*map(F.lit, [301, 404, 503, 429, 999, 204] + [200] * 4)), k % 10 + 1)
    kind = F.element_at(
        F.array(*map(F.lit, ["3xx", "4xx", "5xx", "4xx", "other"] + ["2xx"] * 5)), k % 10 + 1)
    return staged.join(sized, "page_id").select(
        "event_id", "k", "job_id", "ts", "stage", "url",
        F.coalesce(F.nullif(F.regexp_extract("url", HOST, 1), F.lit("")), F.lit("unknown")).alias("site"),
        F.when(counted, F.col("size")).otherwise(_long(0)).alias("bytes"),
        F.when(counted, _long(1)).otherwise(_long(0)).alias("visits"),
        code.alias("status_code"),
        F.when(done, kind).alias("status_class"),
        F.when(done, F.floor(F.col("value") * 20))
        .when(F.col("stage").isin("JOB_DONE", "JOB_ERROR"), F.floor(F.col("value") * 2000))
        .otherwise(_long(0)).cast("bigint").alias("dur_ms"),
        F.when((F.col("stage") == "JOB_ERROR") & (k % 2 == 0),
               F.concat(F.lit("err-"), k.cast("string"))).alias("note"),
    )


@lru_cache(maxsize=1)  # the parts of one query share one plan
def crawl_events(spark: SparkSession, folder: str) -> DataFrame:
    return progress_from(tables.events(spark, folder), tables.pages(spark, folder))


def dirty_events(spark: SparkSession, folder: str) -> DataFrame:
    return dirty_from(crawl_events(spark, folder))


def dirty_from(events: DataFrame) -> DataFrame:
    """Progress events in which every validation rule fails somewhere."""
    case = F.col("k") % 25
    return events.select(
        "event_id",
        F.when(case == 4, F.lit("00000000-0000-0000-0000-000000000000"))
        .when(case == 5, F.lit(None)).otherwise(F.col("job_id")).alias("job_id"),
        F.when(case != 3, F.col("ts")).alias("ts"),
        "stage",
        F.when(case == 0, F.lit(None)).when(case == 6, F.lit("")).otherwise(F.col("site")).alias("site"),
        "url", "bytes", "visits",
        F.when(case != 1, F.col("status_class")).alias("status_class"),
        F.when(case == 2, _long(-1)).otherwise(F.col("dur_ms")).alias("dur_ms"),
        "note",
    )


def url_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Page URLs in many spellings; each ten pages in a row belong to one job."""
    url = F.col("url")
    origin = F.regexp_extract(url, r"^(https?://[^/?#]*)", 1)
    plain = F.regexp_extract(url, r"^([^?#]*)", 1)
    spellings = [
        url,
        F.replace(url, F.lit("http"), F.lit("HTTP")),
        F.replace(url, F.lit(".example."), F.lit(".EXAMPLE.")),
        F.concat(origin, F.when(url.startswith("https:"), ":443").otherwise(":80"), F.lit("/p")),
        F.concat(plain, F.lit("?z=9&a=1&m=5#frag")),
        F.concat(origin, F.lit(":8080/x")),
        F.lit("not a url"),
    ]
    raw = F.when(F.col("page_id") % 7 == 0, spellings[0])
    for i, spelling in enumerate(spellings[1:], 1):
        raw = raw.when(F.col("page_id") % 7 == i, spelling)
    return tables.pages(spark, folder).select(
        "page_id", F.floor(F.col("page_id") / 10).cast("bigint").alias("job_no"),
        raw.alias("raw_url"),
    )


#: Added to the page's number for the second fetch that some pages have.
SECOND_FETCH = 1 << 40


def fetches_from(pages: DataFrame) -> DataFrame:
    """Fetch responses with a body for every branch of the promotion rule.

    Every page gives a response with its whole text; some give a second one with
    an empty or a short body.
    """
    html = F.col("html")
    number = F.col("page_id") % 6
    whole = (
        F.when(number == 3, F.concat(html, F.lit('<div id="root"></div>')))
        .when(number == 4, F.concat(F.lit("<SCRIPT>"), html))
        .otherwise(html)
    )
    second = (
        F.when(number == 1, "")
        .when(number == 2, "<html><script>var a=1;</script><p>t</p></html>")
        .when(number == 5, F.concat(F.lit("<html><body><p>"), F.col("url"), F.lit("</p></body></html>")))
    )
    pages = pages.select("page_id", "url", F.posexplode(
        F.when(number.isin(1, 2, 5), F.array(whole, second)).otherwise(F.array(whole))).alias("variant", "body"))
    page_id = F.col("page_id")
    kind = F.when(page_id % 3 == 0, "text/html").when(page_id % 3 == 1, "text/plain; charset=ascii")
    epoch = F.lit(1704067200).cast("bigint")  # 2024-01-01 00:00:00 UTC
    return pages.select(
        (page_id + F.col("variant") * F.lit(SECOND_FETCH)).alias("fetch_id"),
        job_id_of(page_id % 20).alias("job_id"),
        F.timestamp_seconds(epoch + page_id % 20 * 3600).cast("timestamp_ntz").alias("job_started_at"),
        "url",
        F.when(page_id % 10 == 8, 404).when(page_id % 10 == 9, 503).otherwise(200).alias("status_code"),
        content.response_headers(
            F.when(kind.isNotNull(), F.create_map(F.lit("Content-Type"), F.array(kind)))
        ).alias("headers"),
        "body",
        (page_id * 37 % 5000).alias("dur_ms"),
        F.timestamp_seconds(epoch + page_id * 17 % 2592000).cast("timestamp_ntz").alias("fetched_at"),
        F.lit(False).alias("used_headless"),
    )


def fetches(spark: SparkSession, folder: str) -> DataFrame:
    return fetches_from(tables.pages(spark, folder))


def fetch_rows_from(pages: DataFrame) -> DataFrame:
    """Those responses as fetchers store them: bodies in bytes, some of which aren't UTF-8, screenshots, robots.txt."""
    number = F.col("fetch_id")
    return fetches_from(pages).withColumns({
        "body": F.when(number % 9 == 2, F.concat(F.to_binary(F.lit("fffe"), F.lit("hex")), F.encode("body", "UTF-8")))
        .otherwise(F.encode("body", "UTF-8")),
        "screenshot": F.when(number % 5 == 0, F.encode(F.concat(F.lit("PNG"), F.col("url")), "UTF-8")),
        "robots_status": F.when(number % 8 == 3, "indeterminate").otherwise(""),
        "robots_reason": F.when(number % 8 == 3, "TLS handshake timeout"),
    })


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Probe answers to the tasks of `submissions`: those of every page but each thirteenth, by job and place there."""
    from ..operators import slices

    placed = slices.row_numbers(url_variants(spark, folder).select("page_id", "job_no"), ["job_no"], ["page_id"], "pos")
    task = placed.where(F.col("page_id") % 13 != 5).select(
        F.col("page_id").alias("fetch_id"), job_id_of(F.col("job_no")).alias("job_id"), (F.col("pos") - 1).alias("pos"))
    return fetches(spark, folder).drop("job_id").join(task, "fetch_id")


def policy(spark: SparkSession, folder: str) -> DataFrame:
    """A rule for every site, and for one path of it."""
    site = F.regexp_extract("url", HOST, 1)
    sites = tables.pages(spark, folder).select(site.alias("host")).distinct()
    size = F.length("host")
    none = F.lit(None).cast("bigint")
    whole = sites.select(
        F.lit(None).cast("string").alias("job_id"), "host", F.lit("").alias("path"), none.alias("min_depth"),
        none.alias("max_depth"), F.lit(0).alias("priority"), (size % 3 != 0).alias("allow_fetch"),
        (size % 2 == 0).alias("allow_headless"))
    return whole.unionByName(whole.withColumns({"path": F.lit("/p"), "allow_fetch": F.lit(True)}))


def headless_fetches(spark: SparkSession, folder: str) -> DataFrame:
    """Headless answers for promoted pages; every fourth page failed and has none."""
    probes = fetches(spark, folder)
    answered = content.should_promote(F.col("status_code"), F.col("body"))
    return probes.where(answered & (F.col("fetch_id") % 4 != 0)).withColumns({
        "url": F.concat("url", F.lit("/headless")),
        "body": F.lit("<html>rendered</html>"),
        "dur_ms": F.col("dur_ms") + 1000,
        "used_headless": F.lit(True),
    })


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Probe attempts per URL: `ok`, `err` or `ctx` (the job ended meanwhile)."""
    k = F.col("k")
    last = F.least(k % 6, F.when(k % 17 == 3, 1).otherwise(3))
    result = (
        F.when(F.col("attempt") == k % 6, "ok")
        .when((k % 17 == 3) & (F.col("attempt") == 1), "ctx")
        .otherwise("err")
    )
    return (
        crawl_events(spark, folder).where(F.col("stage") == "FETCH_DONE")
        .select("job_id", F.col("event_id").alias("pos"), "url", "k",
                F.explode(F.sequence(F.lit(0), last)).alias("attempt"))
        .select("job_id", "pos", "url", "attempt", result.alias("result"))
    )


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """What became of each URL of a job, in URL order."""
    number, pos, k = job_number_of(F.col("job_id")), F.col("pos"), F.col("k")
    outcome = (
        F.when(pos % 31 == 13, "blocked")
        .when(pos % 29 == 11, "rate_limited")
        .when((k % 17 == 3) & (k % 6 > 0), "canceled")
        .when(k % 6 > 3, "exhausted")
        .when((number % 13 == 0) | (pos % 23 == 7), "persist_failed")
        .otherwise("success")
    )
    return (
        crawl_events(spark, folder).where(F.col("stage") == "FETCH_DONE")
        .select("job_id", F.col("event_id").alias("pos"), "url", "k", "bytes")
        .withColumn("outcome", outcome)
        .select(
            "job_id", "pos", "url", "bytes", "outcome",
            F.when(~F.col("outcome").isin("success", "blocked"),
                   F.concat(F.col("outcome"), F.lit(" at "), pos.cast("string"))).alias("error"),
            ((F.col("outcome") == "canceled") & (pos % 2 == 0)).alias("job_ended"),
        )
    )


def submissions(spark: SparkSession, folder: str) -> DataFrame:
    """Job requests with absent, zero and set values; URL lists hold at most ten."""
    users = tables.events(spark, folder).groupBy(F.col("user_id").alias("job_no")).agg(
        F.min("ts").alias("submitted_at"))
    urls = (
        url_variants(spark, folder).groupBy("job_no")
        .agg(F.transform(
            F.array_sort(F.collect_list(F.struct("page_id", "raw_url"))),
            lambda u: u["raw_url"]).alias("urls"))
    )
    n = F.col("job_no")
    none = F.lit(None)
    return users.join(urls, "job_no", "left").select(
        "job_no", job_id_of(n).alias("job_id"), "submitted_at",
        F.when(n % 11 == 0, "missing-template").when(n % 5 == 0, "price-refresh").alias("template"),
        F.when(n % 3 == 0, none).when(n % 3 == 1, 0).otherwise(4).cast("bigint").alias("max_depth"),
        F.when(n % 4 == 0, none).when(n % 4 == 1, 0).otherwise(25).cast("bigint").alias("max_pages"),
        F.when(n % 5 == 0, none).when(n % 5 == 1, 0).otherwise(60).cast("bigint").alias("budget_seconds"),
        F.when(n % 3 == 0, none).otherwise(n % 3 == 1).alias("headless_allowed"),
        F.when(n % 2 == 0, none).otherwise(F.lit(False)).alias("respect_robots"),
        F.coalesce("urls", F.array().cast("array<string>")).alias("urls"),
    )


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Frontier: the URLs of a job in order, with caps, budget and depth."""
    number = job_number_of(F.col("job_id"))
    return (
        crawl_events(spark, folder).where(F.col("stage") == "FETCH_DONE")
        .select(
            "job_id", F.col("event_id").alias("pos"), "ts", "url", F.col("site").alias("host"),
            "dur_ms", (F.col("event_id") % 3).alias("depth"),
            F.lit(1).cast("bigint").alias("max_depth"),
            F.lit(10).cast("bigint").alias("max_pages"),
            F.when(F.length("site") % 2 == 0, _long(3)).alias("domain_cap"),
            F.when(number % 3 != 0, number % 7 * 10).alias("budget_seconds"),
        )
    )


def job_updates(spark: SparkSession, folder: str) -> DataFrame:
    """Status updates written by workers."""
    status = (
        F.when(F.col("stage") == "JOB_START", "running")
        .when(F.col("stage") == "JOB_DONE", "succeeded")
        .when(F.col("stage") == "JOB_ERROR", "failed")
    )
    return crawl_events(spark, folder).select(
        "job_id", F.col("event_id").alias("seq"), "ts", status.alias("status"),
        F.coalesce("note", F.lit("")).alias("error_text"),
        F.when(F.col("stage") == "JOB_START", _long(0)).otherwise(F.col("k").cast("bigint")).alias("pages_succeeded"),
        (F.col("k") % 3).cast("bigint").alias("pages_failed"),
    ).where(F.col("status").isNotNull())


def cancel_requests(spark: SparkSession, folder: str) -> DataFrame:
    return crawl_events(spark, folder).where(F.col("stage") == "JOB_CANCELED").select(
        "job_id", F.col("event_id").alias("seq"), "ts")


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """API request log."""
    k = F.col("k")
    return _with_k(tables.events(spark, folder)).select(
        "event_id", "ts",
        F.when(k % 3 == 0, "POST").otherwise("GET").alias("method"),
        F.when(k % 4 == 0, "/v1/jobs/custom").when(k % 4 == 1, "/api/jobs")
        .when(k % 4 == 2, "/api/jobs/{job_id}").alias("route"),
        F.when(k % 20 == 7, 500).when(k % 20 == 8, 404).otherwise(200).alias("code"),
        (F.col("value") / 100.0).alias("dur_s"),
    )


def robots_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts to read robots.txt of each site."""
    h = F.length("site") % 5
    result = (
        F.when((h == 4) | (F.col("attempt") < h), "transient")
        .when(h == 3, "fatal").otherwise("ok")
    )
    return (
        crawl_events(spark, folder).select("site").distinct()
        .select("site", F.explode(F.sequence(F.lit(0), F.least(h, F.lit(3)))).alias("attempt"))
        .select("site", "attempt", result.alias("result"))
    )


def observations(spark: SparkSession, folder: str) -> DataFrame:
    return observations_from(crawl_events(spark, folder))


def observations_from(events: DataFrame) -> DataFrame:
    """Page observations over time: what the page counters saw."""
    return events.where(F.col("stage") == "FETCH_DONE").select(
        "event_id", "ts", "url", "bytes",
        F.when(F.col("k") % 7 == 5, "error").otherwise("success").alias("status"))
