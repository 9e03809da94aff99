"""Page bodies, headers, JSON texts and page ids as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .times import micros


def body_size(body: Column) -> Column:
    return F.octet_length(body).cast("bigint")


def content_hash(body: Column) -> Column:
    """SHA-256 of the body, in hex."""
    return F.sha2(body.cast("binary"), 256)


# A script runs to its closing tag, or to the end if it or its tag never closes.
_SCRIPT = r"(?is)<script[^>]*(?:>.*?(?:</script>|\z)|\z)"


def script_coverage(body: Column) -> Column:
    """Bytes of the body that lie in script elements, tags included."""
    # In Latin-1 one character is one byte, whatever the body holds.
    text = F.decode(body.cast("binary"), "ISO-8859-1")
    return (F.length(text) - F.length(F.regexp_replace(text, _SCRIPT, ""))).cast("bigint")


def script_dense(body: Column) -> Column:
    dense = script_coverage(body) * 100 >= body_size(body) * C.SCRIPT_SHARE_PERCENT
    return F.coalesce(dense & (body_size(body) > 0), F.lit(False))


def should_promote(status: Column, body: Column,
                   threshold: int = C.PROMOTION_THRESHOLD) -> Column:
    """Whether a probed page needs a headless browser.

    The cheap tests come first; the script pattern only runs over bodies below
    the size threshold.
    """
    threshold = threshold or C.PROMOTION_THRESHOLD
    marked = reduce(lambda a, b: a | b, [body.contains(m) for m in C.SPA_MARKERS])
    return (
        F.when((status != 200) | status.isNull(), False)
        .when(body.isNull() | (body_size(body) == 0), True)
        .when((body_size(body) < threshold) & script_dense(body), True)
        .otherwise(marked)
    )


def canonical_header(name: Column) -> Column:
    """Header name as HTTP libraries store it: `x-request-ID` is `X-Request-Id`."""
    word = F.transform(
        F.split(name, "-"),
        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30))),
    )
    legal = name.rlike(r"^[!#$%&'*+\-.^_`|~0-9A-Za-z]+\z")
    return F.when(legal, F.array_join(word, "-")).otherwise(name)


def content_type(headers: Column, default: str = C.DEFAULT_CONTENT_TYPE) -> Column:
    """First Content-Type value, or the default if there is none."""
    found = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == "content-type")
    first = F.try_element_at(F.try_element_at(found, F.lit(1))["value"], F.lit(1))
    return F.coalesce(F.nullif(first, F.lit("")), F.lit(default))


def escape_markup(json: Column) -> Column:
    """JSON text with &, < and > as escapes. They only occur inside strings."""
    for char, escape in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        json = F.replace(json, F.lit(char), F.lit(escape))
    return json


def headers_json(headers: Column) -> Column:
    """Headers as JSON, names in order, every value a list; none is `{}`."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(headers)))
    return F.coalesce(escape_markup(F.to_json(ordered)), F.lit("{}"))


def meta_json(url: Column, status: Column, size: Column, sha256: Column,
              kind: Column, job_id: Column) -> Column:
    """Metadata document stored beside a page."""
    return escape_markup(F.to_json(F.struct(
        url.alias("url"), status.alias("status"), size.alias("size"),
        sha256.alias("sha256"), kind.alias("content_type"),
        F.lit("").alias("parent_id"), job_id.alias("job_uuid"),
    )))


def message_json(page_id: Column, job_id: Column, site: Column, url: Column,
                 html_blob: Column, meta_blob: Column) -> Column:
    """Completion message of a stored page."""
    return escape_markup(F.to_json(F.struct(
        page_id.alias("crawl_id"), html_blob.alias("html_blob"),
        job_id.alias("job_id"), meta_blob.alias("meta_blob"),
        F.lit(C.MESSAGE_SCHEMA_VERSION).alias("schema_version"),
        site.alias("site"), url.alias("url"),
    )))


def time_ordered_id(ts: Column, key: Column) -> Column:
    """A version 7 UUID: milliseconds first, the rest a hash of `key`.

    The same row always gets the same id, so a repeated task writes the same
    page again.
    """
    millis = F.lpad(F.lower(F.hex(F.floor(micros(ts) / 1000).cast("bigint"))), 12, "0")
    digest = F.sha2(key.cast("string").cast("binary"), 256)
    variant = F.translate(F.substring(digest, 4, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat(
        F.substring(millis, 1, 8), F.lit("-"), F.substring(millis, 9, 4), F.lit("-7"),
        F.substring(digest, 1, 3), F.lit("-"), variant, F.substring(digest, 5, 3),
        F.lit("-"), F.substring(digest, 8, 12),
    )


def response_url(captured: Column, final: Column, requested: Column) -> Column:
    """Captured URL, else the final location, else the requested one."""
    empty = F.lit("")
    return F.coalesce(F.nullif(captured, empty), F.nullif(final, empty), requested)


def response_status(status: Column) -> Column:
    return F.when(F.coalesce(status, F.lit(0)) == 0, 200).otherwise(status)


def response_headers(headers: Column) -> Column:
    return F.coalesce(headers, F.map_from_entries(
        F.array().cast("array<struct<k:string,v:array<string>>>")))
