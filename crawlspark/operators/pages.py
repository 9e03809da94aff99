"""Stored pages: headless replacement, artifacts, retrieval rows and messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions import content, times, urls
from . import slices


def with_text(rows: DataFrame) -> DataFrame:
    """Fetch rows with their bodies as text; bytes that aren't UTF-8 become the replacement character.
    Sizes and hashes are to be taken of the bytes."""
    return rows.withColumn("body", F.make_valid_utf8(F.col("body").cast("string")))


def robots_warnings(rows: DataFrame) -> DataFrame:
    """Responses whose robots.txt could not be read for certain; they were fetched as if it allowed all."""
    return rows.where(F.col("robots_status") == C.ROBOTS_INDETERMINATE).select(
        "fetch_id", "job_id", "url", F.coalesce("robots_reason", F.lit("")).alias("reason"))


def final_responses(
    probes: DataFrame, headless: DataFrame, *, threshold: int = C.PROMOTION_THRESHOLD,
    detector: Callable[[Column, Column], Column] | None = None,
    allowed: Column | None = None,
) -> DataFrame:
    """Probe responses, replaced by the headless one where a page was promoted.

    `headless` holds successful renderings by `fetch_id`; a promoted page
    without one keeps its probe. Pages that are not promoted, by far the most,
    stay out of the join, so their bodies are never shuffled.
    """
    body = F.col("body")
    if isinstance(probes.schema["body"].dataType, T.BinaryType):
        body = F.make_valid_utf8(body.cast("string"))
    promote = (
        detector(F.col("status_code"), body) if detector
        else content.should_promote(F.col("status_code"), body, threshold))
    if allowed is not None:
        promote = promote & F.coalesce(allowed, F.lit(True))
    promote = F.coalesce(promote, F.lit(False))  # no answer: the probe stays
    probes = probes.withColumn("requested_url", F.col("url"))
    swapped = ["url", "status_code", "headers", "body", "dur_ms", "used_headless"]
    if "screenshot" in headless.columns:
        swapped.append("screenshot")
        if "screenshot" not in probes.columns:
            probes = probes.withColumn("screenshot", F.lit(None).cast(headless.schema["screenshot"].dataType))
    rendered = headless.select("fetch_id", F.struct(*swapped).alias("h"))
    promoted = probes.where(promote).join(rendered, "fetch_id", "left").withColumns({
        c: F.when(F.col("h").isNotNull(), F.col(f"h.{c}")).otherwise(F.col(c)) for c in swapped
    }).drop("h")
    return probes.where(~promote).unionByName(promoted)


def stored_pages(
    responses: DataFrame, *, backend: str = "memory", base: str = "",
    prefix: str = C.DEFAULT_BLOB_PREFIX, default_type: str = C.DEFAULT_CONTENT_TYPE,
    page_id: Column | None = None, hasher: Callable[[Column], Column] = content.content_hash,
    keep_body: bool = False,
) -> DataFrame:
    """Everything recorded about a stored page; its body only on request."""
    if page_id is None:
        page_id = content.time_ordered_id(
            F.col("fetched_at"), F.concat_ws(":", "job_id", F.col("fetch_id").cast("string")))
    requested = F.col("requested_url") if "requested_url" in responses.columns else F.col("url")
    base_columns = responses.select(
        "fetch_id", "job_id", "job_started_at", "url", "status_code", "headers", "dur_ms",
        "fetched_at", "used_headless",
        urls.normalize_or_raw(requested).alias("requested_url"),
        page_id.alias("id"), hasher(F.col("body")).alias("content_hash"),
        content.body_size(F.col("body")).alias("size"),
        content.content_type(F.col("headers"), default_type).alias("content_type"),
        urls.extract_host(F.col("url")).alias("site"),
        *[c for c in ("body", "screenshot") if c in responses.columns and (keep_body or c != "body")])
    folder = urls.blob_base(F.col("fetched_at"), F.col("site"), F.col("id"), prefix)
    return base_columns.withColumn("blob_base", folder).withColumns({
        "html_blob": urls.blob_uri(F.concat("blob_base", F.lit("/raw.html")), backend, base),
        "meta_blob": urls.blob_uri(F.concat("blob_base", F.lit("/meta.json")), backend, base),
    })


def retrievals(pages: DataFrame, **more: Column) -> DataFrame:
    """Retrieval rows, with columns of one's own at the end. Pages without an id are refused."""
    return pages.where(F.coalesce("id", F.lit("")) != "").select(
        "id", "job_id", "job_started_at",
        times.hour_of(F.col("fetched_at")).alias("partition_ts"),
        F.col("fetched_at").alias("retrieval_timestamp"),
        F.col("url").alias("retrieval_url"),
        F.col("content_hash").alias("retrieval_hashcode"),
        F.col("html_blob").alias("retrieval_blob_location"),
        content.headers_json(F.col("headers")).alias("retrieval_headers"),
        F.col("status_code").alias("retrieval_status_code"),
        F.col("content_type").alias("retrieval_content_type"),
        F.lit(None).cast("string").alias("parent_id"),
        F.lit(None).cast("timestamp_ntz").alias("parent_ts"),
        *[column.alias(name) for name, column in more.items()])


def _write(rows: DataFrame, path: str, layout: list[str], run_id: str | None) -> None:
    """Append; or, with the id of a run, replace what an earlier try of that run wrote."""
    if run_id is None:
        rows.write.mode("append").partitionBy(*layout).parquet(path)
    else:
        rows.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy(*layout, "run_id").parquet(path)


def write_retrievals(rows: DataFrame, path: str, run_id: str | None = None) -> None:
    """Add to a table partitioned by hour; a repeated run counts once if it has an id.
    A rebalance splits busy hours and merges quiet ones, so files come out evenly sized.
    All writes to a table either have ids or have none."""
    _write(rows.hint("rebalance", "partition_ts"), path, ["partition_ts"], run_id)


def message() -> Column:
    """The completion message of a stored page."""
    return content.message_json(
        F.col("id"), F.col("job_id"), F.col("site"), F.col("requested_url"), F.col("html_blob"), F.col("meta_blob"))


def notifications(pages: DataFrame, topic: str | None) -> DataFrame:
    """Completion messages for stored pages; none without a topic."""
    if not topic:
        pages = pages.where(F.lit(False))
    return pages.select(F.lit(topic or "").alias("topic"), message().alias("value"))


def page_meta(pages: DataFrame) -> DataFrame:
    return pages.select("fetch_id", content.meta_json(
        F.col("url"), F.col("status_code"), F.col("size"), F.col("content_hash"),
        F.col("content_type"), F.col("job_id")).alias("meta"))


def artifact_manifest(pages: DataFrame) -> DataFrame:
    """The objects stored for each page: path, type and size."""
    def item(name: str, kind: Column, size: Column) -> Column:
        return F.struct(
            F.concat("blob_base", F.lit("/" + name)).alias("path"), kind.alias("object_type"),
            size.cast("bigint").alias("object_bytes"))

    headers = content.headers_json(F.col("headers"))
    meta = content.meta_json(
        F.col("url"), F.col("status_code"), F.col("size"), F.col("content_hash"),
        F.col("content_type"), F.col("job_id"))
    json = F.lit("application/json")
    items = [
        item("raw.html", F.lit(C.DEFAULT_CONTENT_TYPE), F.col("size")),
        item("headers.json", json, F.octet_length(headers)),
        item("meta.json", json, F.octet_length(meta)),
    ]
    if "screenshot" in pages.columns:
        shot = F.col("screenshot")
        some = F.coalesce(F.octet_length(shot), F.lit(0)) > 0
        items.append(F.when(some, item("screenshot.png", F.lit("image/png"), F.octet_length(shot))))
    listed = F.filter(F.array(*items), lambda i: i.isNotNull())
    return pages.select("id", F.inline(listed))


LAYOUT = ["yyyymm", "dd", "hh"]
ARTIFACTS = (
    "id string, fetch_id bigint, job_id string, url string, body string, headers string,"
    "meta string, screenshot binary, blob_base string, host string, yyyymm string, dd string, hh string"
)


def artifact_rows(responses: DataFrame, **options) -> DataFrame:
    """Pages with body, documents and layout columns, a row per page."""
    ts = F.col("fetched_at")
    shot = F.col("screenshot") if "screenshot" in responses.columns else F.lit(None)
    return stored_pages(responses, keep_body=True, **options).select(
        "id", "fetch_id", "job_id", "url", "body",
        content.headers_json(F.col("headers")).alias("headers"),
        content.meta_json(
            F.col("url"), F.col("status_code"), F.col("size"), F.col("content_hash"),
            F.col("content_type"), F.col("job_id")).alias("meta"),
        shot.cast("binary").alias("screenshot"), "blob_base", urls.sanitize_host(F.col("site")).alias("host"),
        F.date_format(ts, "yyyyMM").alias("yyyymm"),
        F.date_format(ts, "dd").alias("dd"), F.date_format(ts, "HH").alias("hh"))


def write_artifacts(responses: DataFrame, path: str, run_id: str | None = None, **options) -> None:
    """Write bodies with their documents as Parquet, laid out by hour.

    One row per page instead of three small files. A folder per host would make
    millions of them, so hosts are kept together by sorting: a filter on the
    host skips row groups. The rebalance keeps an hour in few files and splits
    hours too large for one task.
    """
    rows = artifact_rows(responses, **options).hint("rebalance", *LAYOUT)
    _write(rows.sortWithinPartitions(*LAYOUT, "host"), path, LAYOUT, run_id)


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Rows written by `write_artifacts`; filters on the layout skip folders."""
    return spark.read.schema(ARTIFACTS).parquet(path)


_TREE = r"([0-9]{6})/([0-9]{2})/([0-9]{2})/host=([^/]*)/id=([^/]*)/([^/]+)$"


def read_artifact_tree(spark: SparkSession, path: str, name: str = "raw.html") -> DataFrame:
    """Stored objects of one name from a raw folder tree, their layout read from the path."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", name).load(path)
    )
    parts = [
        F.regexp_extract("path", _TREE, i + 1).alias(c)
        for i, c in enumerate(["yyyymm", "dd", "hh", "host", "id"])
    ]
    return files.where(F.col("path").rlike(_TREE)).select(
        *parts, F.col("content").alias("body"), F.col("length").alias("size"), "path")


def collect_headers(pairs: DataFrame) -> DataFrame:
    """Header pairs (`response_id`, `pos`, `name`, `value`) as one map per
    response. Names are put in their usual spelling, repeated ones keep all
    values in order. A response's headers are few by nature."""
    by_name = pairs.groupBy("response_id", content.canonical_header(F.col("name")).alias("name")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", F.col("value").cast("string").alias("value")))),
            lambda e: e["value"]).alias("values"))
    return by_name.groupBy("response_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "values")))).alias("headers"))


def dedup_by_hash(pages: DataFrame) -> DataFrame:
    """One row per distinct body: the earliest page and the number of copies.
    Only hashes and ids are shuffled."""
    return pages.select(
        "fetch_id", "fetched_at", content.content_hash(F.col("body")).alias("content_hash")
    ).groupBy("content_hash").agg(
        F.min_by("fetch_id", F.struct("fetched_at", "fetch_id")).alias("fetch_id"),
        F.count(F.lit(1)).alias("copies"))


def number_pages(pages: DataFrame) -> DataFrame:
    """Pages of every job, numbered in the order they were stored."""
    return slices.row_numbers(pages, ["job_id"], ["fetched_at", "fetch_id"], "seq")


def list_pages(pages: DataFrame, job_id: str) -> DataFrame:
    """Pages of a job in the order they were stored."""
    return pages.where(F.col("job_id") == job_id).orderBy("fetched_at", "fetch_id")
