"""Time columns. Tables hold UTC times without a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since the epoch; the session time zone must be UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(value: Column) -> Column:
    return F.timestamp_micros(value).cast("timestamp_ntz")


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def window_start(ts: Column, seconds: int) -> Column:
    """Start of the tumbling window that holds `ts`."""
    width = seconds * 1_000_000
    return from_micros(F.floor(micros(ts) / width).cast("bigint") * width)


def rfc3339(ts: Column) -> Column:
    """RFC 3339 text in UTC without trailing zeros in the fraction."""
    return F.concat(
        F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0+$", ""),
        F.lit("Z"),
    )
