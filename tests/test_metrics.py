import random

from pyspark.sql import functions as F

from crawlspark import constants as C
from crawlspark.operators import metrics, ratelimit
from crawlspark.sources import schemas
from test_progress import event, frame


def test_counters_of_one_job(spark):
    rows = [
        event(0, "j", "JOB_START", 0, dur=0), event(1, "j", "FETCH_DONE", 10, "example.com", 1024, 1, "2xx", 200),
        event(2, "j", "JOB_DONE", 15, dur=15000),
    ]
    df = frame(spark, rows)
    assert {r.counter: r.value for r in metrics.job_event_counts(df).collect()} == {"started": 1, "success": 1}
    assert [tuple(r) for r in metrics.fetch_requests(df).collect()] == [("example.com", "2xx", 1)]
    assert [tuple(r) for r in metrics.fetch_bytes(df).collect()] == [("example.com", 1024)]
    hist = {r.le: r.bucket_count for r in metrics.fetch_duration_hist(df).collect()}
    assert hist == {"0.01": 0, "0.05": 0, "0.1": 0, "0.5": 1, "1": 1, "2": 1, "5": 1, "10": 1, "+Inf": 1}
    hist = {r.le: r.bucket_count for r in metrics.job_runtime_hist(df).collect()}
    assert (hist["5"], hist["15"], hist["+Inf"]) == (0, 1, 1)
    blank = frame(spark, [event(0, "j", "FETCH_DONE", 0, site=None, kind="")])
    assert [tuple(r) for r in metrics.fetch_requests(blank).collect()] == [("unknown", "other", 1)]
    assert schemas.PROGRESS_EVENT.fieldNames() == df.columns


def test_histogram_and_quantile(spark):
    rng = random.Random(4)
    rows = [(g, rng.expovariate(1 / s)) for g, s in (("a", 0.2), ("b", 3), ("c", 40)) for _ in range(200)]
    rows += [("d", 9.0), ("e", 0.05)]
    df = spark.createDataFrame(rows, "g string, v double")
    bounds = C.HTTP_LATENCY_BOUNDS
    hist = {(r.g, r.le): r.bucket_count for r in metrics.histogram(df, F.col("v"), bounds, ["g"]).collect()}
    quantiles = {r.g: r.q for r in metrics.quantile_from_buckets(df, F.col("v"), bounds, ["g"], 0.95, "q").collect()}
    for g in "abcde":
        seen = [v for h, v in rows if h == g]
        counts = [sum(v <= b for v in seen) for b in bounds]
        assert [hist[g, f"{b:g}"] for b in bounds] == counts and hist[g, "+Inf"] == len(seen)
        rank = 0.95 * len(seen)
        at = next((i for i, c in enumerate(counts) if c >= rank), None)
        if at is None:
            want = bounds[-1]
        else:
            low, below = (bounds[at - 1], counts[at - 1]) if at else (0, 0)
            want = low + (bounds[at] - low) * (rank - below) / (counts[at] - below)
        assert abs(quantiles[g] - want) < 1e-5


def test_pages_and_bytes(spark):
    attempts = spark.createDataFrame(
        [("HTTP://A.com:80/x", r) for r in ("err", "ctx", "ok")], "url string, result string")
    outcomes = spark.createDataFrame(
        [("http://a.com/x", "success", 10), ("http://a.com/x", "persist_failed", 5), ("http://a.com/x", "exhausted", 9),
         ("nope", "success", 0)], "url string, outcome string, bytes bigint")
    got = sorted(tuple(r) for r in metrics.pages_total(attempts, outcomes).collect())
    assert got == [("a.com", "error", 3), ("a.com", "success", 1), ("nope", "success", 1)]
    assert [tuple(r) for r in metrics.bytes_total(outcomes).collect()] == [("a.com", 15)]


def test_robots(spark):
    cases = {"open": ["transient"] * 4, "good": ["transient", "ok"], "bad": ["transient", "transient", "fatal"], "first": ["ok"]}
    df = spark.createDataFrame([(s, n, r) for s, rs in cases.items() for n, r in enumerate(rs)], "site string, attempt int, result string")
    outcomes = metrics.robots_outcome(df)
    got = {r.site: tuple(r)[1:] for r in outcomes.collect()}
    assert got == {
        "open": ("indeterminate", "TLS handshake timeout", True, 4, 1750), "good": ("fetched", "", True, 2, 250),
        "bad": ("failed", "", False, 3, 750), "first": ("fetched", "", True, 1, 0)}
    assert metrics.tls_timeouts(outcomes).first().timeouts == 1


def test_request_labels(spark):
    log = spark.createDataFrame([("GET", None, 200, 0.1), ("GET", "", 404, 7.0)], "method string, route string, code int, dur_s double")
    hist = {(r.route, r.le): r.bucket_count for r in metrics.http_latency_hist(log).collect()}
    assert hist["unknown", "0.1"] == 1 and hist["unknown", "+Inf"] == 2
    assert {(r.code, r.requests) for r in metrics.http_requests(log).collect()} == {("200", 1), ("404", 1)}


def test_waits_whose_sum_is_beyond_a_bigint(spark):
    wait = 5 * 10 ** 18
    schedule = spark.createDataFrame(
        [("a", wait), ("a", wait), ("a", wait), ("a", 1000), ("b", 1001)], "domain string, delay_us bigint")
    got = {(r.domain, r.le): (r.bucket_count, r.observations, r.sum_seconds)
           for r in metrics.rate_delay_hist(schedule).collect()}
    assert got["a", "+Inf"] == (3, 3, 1.5e13) and got["a", "30"] == (0, 3, 1.5e13)
    assert got["b", "0.1"] == (1, 1, 0.001)


def test_a_queue_whose_waits_sum_to_more_than_a_bigint(spark):
    """From requests to the histogram: each waits for all before it, 10^15 microseconds apart."""
    asked = spark.range(303).selectExpr("IF(id < 300, 'a', 'b') AS domain", "0L AS arrival_us", "id AS seq").repartition(3)
    got = {(r.domain, r.le): (r.bucket_count, r.observations, r.sum_seconds)
           for r in metrics.rate_delay_hist(ratelimit.rate_limit(asked, 1e-9, 1)).collect()}
    waits = {"a": range(1, 300), "b": range(1, 3)}
    assert sum(waits["a"]) * 10 ** 15 > 2 ** 63
    assert {k: got[k, "+Inf"] for k in waits} == {k: (len(w), len(w), sum(w) * 1e9) for k, w in waits.items()}
    assert got["a", "30"][0] == got["b", "0.1"][0] == 0
