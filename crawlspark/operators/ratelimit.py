"""Token-bucket admission times per domain."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from . import slices

_WIDE = "decimal(38,0)"


def rate_limit(requests: DataFrame, rate: float = C.DEFAULT_RATE_PER_SECOND,
               burst: int = C.DEFAULT_BURST) -> DataFrame:
    """When each request is admitted, for `domain`, `arrival_us` and `seq`.

    The n-th request of a domain waits for its own arrival and, for every
    earlier request k, for n - k + 1 - burst token intervals after it. With
    I the interval, that is max over k of (arrival_k - k*I) + (n - burst + 1)*I:
    a running maximum. The interval is a fraction p/q of microseconds; sums are
    exact in units of 1/q, and only the result is rounded, up.

    Where a domain goes on in another partition, the count and the maximum are
    carried there; counting within a partition shifts a maximum by a known
    multiple of I.
    """
    burst = burst if burst > 0 else 1
    if rate <= 0:  # no limit
        return requests.withColumns({
            "admitted_us": F.col("arrival_us"), "delay_us": F.lit(0).cast("bigint")})
    exact = 1_000_000 / Fraction(rate).limit_denominator(1_000_000_000)
    p, q = F.lit(exact.numerator).cast("decimal(18,0)"), F.lit(exact.denominator).cast("decimal(18,0)")
    keys, order = ["domain"], ["arrival_us", "seq"]

    def intervals(number: Column) -> Column:
        return (number.cast("decimal(19,0)") * p).cast(_WIDE)

    rows = slices.ordered(requests, keys, order)
    local = rows.withColumn("_n", F.row_number().over(slices.inside(keys, order)).cast("bigint"))
    lead = (F.col("arrival_us").cast("decimal(19,0)") * q).cast(_WIDE) - intervals(F.col("_n"))
    local = local.withColumn("_lead", lead.cast(_WIDE))
    local = local.withColumn("_max", F.max("_lead").over(slices.running(keys, order)))

    before = slices.earlier(keys)
    parts = local.groupBy(slices.PART, *keys).agg(
        F.count(F.lit(1)).alias("_count"), F.max("_lead").alias("_top"))
    counted = parts.withColumn("_sum", F.coalesce(F.sum("_count").over(before), F.lit(0)))
    shifted = counted.withColumn("_top", (F.col("_top") - intervals(F.col("_sum"))).cast(_WIDE))
    coming = slices.carried(shifted, keys, _before=F.sum("_count").over(before), _high=F.max("_top").over(before))

    shift = F.coalesce("_before", F.lit(0))
    number = F.col("_n") + shift
    highest = F.greatest((F.col("_max") - intervals(shift)).cast(_WIDE), F.col("_high"))
    due = (highest + intervals(number - burst + 1) + q - 1).cast(_WIDE)
    return (
        slices.carry(local, coming, keys)
        .withColumn("_due", due).withColumn("_q", q)
        .withColumn("admitted_us", F.greatest("arrival_us", F.expr("_due div _q")))
        .withColumn("delay_us", F.col("admitted_us") - F.col("arrival_us"))
        .select(*requests.columns, "admitted_us", "delay_us")
    )


def mark_deadlines(schedule: DataFrame) -> DataFrame:
    """Flag requests admitted only after their job's deadline (`deadline_us`)."""
    return schedule.withColumn(
        "exceeds_deadline", F.coalesce(F.col("admitted_us") > F.col("deadline_us"), F.lit(False)))
