"""Explicit schemas, so that no job infers types from files."""

from pyspark.sql import types as T

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

PROGRESS_EVENT = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("job_id", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("stage", T.StringType()),
    T.StructField("site", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("visits", T.LongType()),
    T.StructField("status_class", T.StringType()),
    T.StructField("dur_ms", T.LongType()),
    T.StructField("note", T.StringType()),
])

FETCH_RESPONSE = T.StructType([
    T.StructField("fetch_id", T.LongType()),
    T.StructField("job_id", T.StringType()),
    T.StructField("job_started_at", T.TimestampNTZType()),
    T.StructField("url", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("headers", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("body", T.StringType()),
    T.StructField("dur_ms", T.LongType()),
    T.StructField("fetched_at", T.TimestampNTZType()),
    T.StructField("used_headless", T.BooleanType()),
])

#: A response as fetchers store it: the body as bytes, the screenshot, and what became of robots.txt.
FETCH_ROW = T.StructType([
    *[T.StructField("body", T.BinaryType()) if f.name == "body" else f for f in FETCH_RESPONSE.fields],
    T.StructField("screenshot", T.BinaryType()),
    T.StructField("robots_status", T.StringType()),
    T.StructField("robots_reason", T.StringType()),
])

RETRIEVAL = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("job_id", T.StringType()),
    T.StructField("job_started_at", T.TimestampNTZType()),
    T.StructField("retrieval_timestamp", T.TimestampNTZType()),
    T.StructField("retrieval_url", T.StringType()),
    T.StructField("retrieval_hashcode", T.StringType()),
    T.StructField("retrieval_blob_location", T.StringType()),
    T.StructField("retrieval_headers", T.StringType()),
    T.StructField("retrieval_status_code", T.IntegerType()),
    T.StructField("retrieval_content_type", T.StringType()),
    T.StructField("parent_id", T.StringType()),
    T.StructField("parent_ts", T.TimestampNTZType()),
    T.StructField("partition_ts", T.TimestampNTZType()),
])
