"""Skewed inputs: one key holds a third of the rows; one partition or many."""

import math
import random
from collections import defaultdict
from datetime import datetime, timedelta
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from crawlspark.operators import frontier, ratelimit, slices, timeline

START = datetime(2024, 1, 1)


@pytest.fixture(autouse=True, params=[1, 9])
def partitions(request, spark):
    """As many partitions as asked for, however few the rows."""
    before = {c: spark.conf.get(c) for c in (
        "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    for c, v in before.items():
        spark.conf.set(c, v)


def skewed(n=3000, keys=40, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.34 else f"k{rng.randrange(keys)}"
        # positions bunch up, and some are equal
        rows.append((key, int(rng.random() ** 3 * 4000), i, rng.randrange(50)))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    rows = skewed()
    return rows, spark.createDataFrame(rows, "k string, at bigint, seq bigint, v bigint").repartition(7)


def by_key(rows):
    groups = defaultdict(list)
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        groups[row[0]].append(row)
    return groups


@pytest.mark.parametrize("kind", ["a third in one key", "one position", "many large keys"])
def test_partitions_are_even(spark, partitions, kind):
    rows = {"a third in one key": skewed(), "one position": [("hot", 5, i, 1) for i in range(3000)],
            "many large keys": [(f"k{i % 300}", i // 300, i, 1) for i in range(6000)]}[kind]
    df = spark.createDataFrame(rows, "k string, at bigint, seq bigint, v bigint").repartition(7)
    sizes = [r["count"] for r in slices.ordered(df, ["k"], ["at", "seq"]).groupBy(slices.PART).count().collect()]
    assert len(sizes) == partitions
    assert max(sizes) < 2 * len(rows) / partitions


def test_row_numbers_and_sums(table):
    rows, df = table
    numbered = slices.row_numbers(df, ["k"], ["at", "seq"], "n")
    summed = slices.running_sum(numbered, ["k"], ["at", "seq"], "v", "total")
    before = slices.previous(summed, ["k"], ["at", "seq"], "v", "before")
    got = {r.seq: (r.n, r.total, r.before) for r in before.collect()}
    want = {}
    for group in by_key(rows).values():
        total, last = 0, None
        for n, row in enumerate(group, 1):
            total += row[3]
            want[row[2]] = (n, total, last)
            last = row[3]
    assert got == want


def test_null_keys_are_a_key(spark):
    df = spark.createDataFrame([(None, i) for i in range(200)] + [("a", i) for i in range(50)], "k string, at bigint")
    got = slices.row_numbers(df, ["k"], ["at"], "n").collect()
    assert all(r.n == r.at + 1 for r in got) and len(got) == 250


def test_running_total(table):
    rows, df = table
    got = slices.running_total(df, ["at", "seq"], "v", "total")
    total, want = 0, {}
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        total += row[3]
        want[row[2]] = total
    assert {r.seq: r.total for r in got.collect()} == want


@pytest.mark.parametrize("rate,burst", [(0.5, 3), (10, 1), (2, 0), (3, 1), (7, 2), (3e6, 1)])
def test_rate_limit(spark, rate, burst):
    rows = [(k, at * 1_000_000, seq) for k, at, seq, _ in skewed(1500, 10, 5)]
    df = spark.createDataFrame(rows, "domain string, arrival_us bigint, seq bigint")
    got = {r.seq: r.admitted_us for r in ratelimit.rate_limit(df, rate, burst).collect()}

    # A token bucket, one request after the other, in exact fractions of microseconds.
    interval, size, want = 1_000_000 / Fraction(rate), max(burst, 1), {}
    for group in by_key(rows).values():
        tokens, last = size * interval, None  # tokens in units of 1/interval
        for _, at, seq in group:
            if last is not None:
                tokens = min(size * interval, tokens + at - last)
            last = at
            tokens -= interval
            want[seq] = at + max(0, math.ceil(-tokens))
    assert got == want


def test_rate_limit_does_not_drift(spark):
    df = spark.range(100_000).selectExpr("'a' AS domain", "0L AS arrival_us", "id AS seq")
    last = ratelimit.rate_limit(df, 3, 1).selectExpr("max(admitted_us)").first()[0]
    assert last == math.ceil(Fraction(99_999 * 1_000_000, 3))


def test_rate_limit_cases(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 0, 2), ("b", 0, 3)], "domain string, arrival_us bigint, seq bigint")
    assert {r.seq: r.delay_us for r in ratelimit.rate_limit(df, 10, 1).collect()} == {1: 0, 2: 100_000, 3: 0}
    assert {r.delay_us for r in ratelimit.rate_limit(df, 0, 1).collect()} == {0}
    late = ratelimit.mark_deadlines(ratelimit.rate_limit(df, 1, 1).withColumn("deadline_us", F.lit(500_000)))
    assert {r.seq: r.exceeds_deadline for r in late.collect()} == {1: False, 2: True, 3: False}


def events_of(spark, rows, stage_of):
    made = [(k, START + timedelta(seconds=at), seq, stage_of(v)) for k, at, seq, v in rows]
    return made, spark.createDataFrame(made, "job_id string, ts timestamp_ntz, event_id bigint, stage string")


def test_running_jobs(spark):
    stages = ["JOB_START", "JOB_DONE", "JOB_ERROR", "FETCH_DONE", "JOB_START"]
    made, df = events_of(spark, skewed(2000, 30, 9), lambda v: stages[v % 5])
    got = {r.event_id: (r.step, r.running) for r in timeline.running_jobs(df).collect()}
    running, want = set(), {}
    for job, _, event, stage in sorted(made, key=lambda e: (e[1], e[2])):
        if stage == "JOB_START" and job not in running:
            running.add(job)
            want[event] = (1, len(running))
        elif stage in ("JOB_DONE", "JOB_ERROR") and job in running:
            running.remove(job)
            want[event] = (-1, len(running))
    assert got == want


@pytest.mark.parametrize("largest,gap", [(4, 20), (1000, 3), (2, 10**6)])
def test_activity_bursts(spark, largest, gap):
    made, df = events_of(spark, skewed(2000, 30, 11), lambda v: "FETCH_DONE")
    got = timeline.activity_bursts(df, largest, gap * 1000).collect()
    want = []
    groups = defaultdict(list)
    for event in sorted(made, key=lambda e: (e[1], e[2])):
        groups[event[0]].append(event)
    for job, group in groups.items():
        batch, last = [], None
        for event in group:
            if batch and event[1] - last > timedelta(seconds=gap):
                want.append((job, batch[0], len(batch)))
                batch = []
            batch.append(event[2])
            last = event[1]
            if len(batch) >= largest:
                want.append((job, batch[0], len(batch)))
                batch = []
        if batch:
            want.append((job, batch[0], len(batch)))
    assert sorted((r.job_id, r.first_event, r.events) for r in got) == sorted(want)


def test_cap_frontier_and_budget(spark):
    rng = random.Random(2)
    rows = []
    for pos in range(2500):
        job = "hot" if rng.random() < 0.34 else f"j{rng.randrange(12)}"
        host = "h" if rng.random() < 0.5 else f"h{rng.randrange(5)}"
        rows.append((job, pos, host, rng.randrange(3), 1, {"h": 7, "h1": None}.get(host, 3),
                     None if job == "j1" else 15, rng.randrange(900), None if job == "j2" else 20, "u"))
    df = spark.createDataFrame(
        rows, "job_id string, pos bigint, host string, depth bigint, max_depth bigint, domain_cap bigint,"
              "max_pages bigint, dur_ms bigint, budget_seconds bigint, url string").repartition(5)
    kept, per_host, per_job = set(), defaultdict(int), defaultdict(int)
    spent, decided = defaultdict(int), {}
    for job, pos, host, depth, deepest, cap, most, dur, budget, _ in rows:
        decided[pos] = "fetched" if spent[job] < (budget or 15) * 1000 else "skipped"
        spent[job] += dur
        if depth > deepest:
            continue
        per_host[job, host] += 1
        if cap is not None and per_host[job, host] > cap:
            continue
        per_job[job] += 1
        if most is None or per_job[job] <= most:
            kept.add(pos)
    assert {r.pos for r in frontier.cap_frontier(df).collect()} == kept
    assert {r.pos: r.decision for r in frontier.apply_budget(df).collect()} == decided
