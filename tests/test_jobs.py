from datetime import datetime

from pyspark.sql import functions as F

from crawlspark.operators import frontier, jobs


def test_parameters(spark):
    rows = [
        ("a", ["u"], None, 0, 5, None, None, None, None), ("b", ["u"], 7, 8, 0, True, False, {"h": 1}, None),
        ("c", [], 1, 1, 1, True, True, None, None), ("d", None, 1, 1, 1, True, True, None, None),
    ]
    df = spark.createDataFrame(
        rows, "job_id string, urls array<string>, max_depth bigint, max_pages bigint, budget_seconds bigint,"
              "headless_allowed boolean, respect_robots boolean, per_domain_caps map<string,int>, tags map<string,string>")
    got = {r.job_id: r for r in jobs.resolve_params(df).collect()}
    assert set(got) == {"a", "b"}
    a, b = got["a"], got["b"]
    assert (a.max_depth, a.max_pages, a.budget_seconds, a.headless_allowed, a.respect_robots) == (1, 10, 5, False, True)
    assert (b.max_depth, b.max_pages, b.budget_seconds, b.headless_allowed, b.respect_robots) == (7, 8, 15, True, False)
    assert a.per_domain_caps == {} and b.per_domain_caps == {"h": 1} and a.tags == {}
    assert {r.job_id for r in jobs.param_rejects(df).collect()} == {"c", "d"}
    other = {r.job_id: r for r in jobs.resolve_params(df, headless=True, ignore_robots=True, max_pages=3).collect()}
    assert (other["a"].headless_allowed, other["a"].respect_robots, other["a"].max_pages) == (True, False, 3)


def test_templates(spark):
    templates = jobs.templates_table(spark, {
        "set": {"urls": ["u", "v"], "headless_allowed": True, "headless_provided": True},
        "unset": {"urls": ["u"], "headless_allowed": True, "max_pages": 60}})
    asked = spark.createDataFrame(
        [("1", "set"), ("2", "unset"), ("3", "gone"), ("4", None)], "job_id string, template string"
    ).withColumn("submitted_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    found, unknown = jobs.expand_templates(asked, templates)
    got = {r.job_id: (r.headless_allowed, r.max_pages) for r in found.collect()}
    assert got == {"1": (True, 10), "2": (False, 60)}
    assert [r.job_id for r in unknown.collect()] == ["3"]
    tasks = jobs.explode_tasks(found).collect()
    assert sorted((r.job_id, r.pos, r.url, r.attempt) for r in tasks) == [
        ("1", 0, "u", 1), ("1", 1, "v", 1), ("2", 0, "u", 1)]


def test_duplicate_jobs(spark):
    incoming = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4), ("a", 5)], "job_id string, seq bigint")
    existing = spark.createDataFrame([("c",), ("c",)], "job_id string")
    assert sorted(map(tuple, jobs.new_jobs(incoming, existing).collect())) == [("a", 1), ("b", 3)]
    assert sorted(r.seq for r in jobs.duplicate_jobs(incoming, existing).collect()) == [2, 4, 5]


def test_job_state(spark):
    def at(h):
        return datetime(2024, 1, 1, h)

    rows = [("j", 1, at(1), "running", "", 0, 0), ("j", 4, at(4), "succeeded", "", 3, 1), ("q", 1, at(1), "failed", "x", 0, 1)]
    updates = spark.createDataFrame(
        rows, "job_id string, seq bigint, ts timestamp_ntz, status string, error_text string,"
              "pages_succeeded bigint, pages_failed bigint")
    cancels = jobs.cancel_updates(spark.createDataFrame(
        [("j", 3, at(3)), ("q", 2, at(2))], "job_id string, seq bigint, ts timestamp_ntz"))
    got = {r.job_id: tuple(r)[1:] for r in jobs.job_state(updates.unionByName(cancels)).collect()}
    assert got["j"] == (at(1), at(4), "succeeded", "", 3, 1)  # the worker's later update wins
    assert got["q"] == (None, at(2), "canceled", "canceled via API", 0, 0)


def test_attempts(spark):
    rows = [("j", 1, "u", n, r) for n, r in enumerate(["err", "err", "ok"])]
    rows += [("j", 2, "u", n, "err") for n in range(5)]
    rows += [("j", 3, "u", 0, "err"), ("j", 3, "u", 1, "ctx"), ("j", 4, "u", 0, "ok")]
    df = spark.createDataFrame(rows, "job_id string, pos bigint, url string, attempt int, result string")
    got = {r.pos: (r.outcome, r.attempts, r.retries) for r in jobs.fold_attempts(df).collect()}
    assert got == {1: ("success", 3, 2), 2: ("exhausted", 4, 3), 3: ("canceled", 2, 1), 4: ("success", 1, 0)}
    waits = {(r.pos, r.attempt): (r.wait_ms, r.total_wait_ms) for r in jobs.retry_waits(df).collect()}
    assert waits[2, 0] == (0, 0) and waits[2, 3] == (3000, 6000) and waits[1, 2] == (2000, 3000)


def test_final_status(spark):
    rows = [
        ("ok", 1, "success", None, False), ("ok", 2, "exhausted", "e2", False), ("ok", 3, "success", None, False),
        ("bad", 1, "exhausted", "e1", False), ("bad", 2, "rate_limited", "e2", False),
        ("none", 1, "blocked", None, False), ("late", 1, "success", None, True),
    ]
    df = spark.createDataFrame(rows, "job_id string, pos bigint, outcome string, error string, job_ended boolean")
    got = {r.job_id: (r.status, r.error_text) for r in jobs.final_status(df).collect()}
    assert got == {"ok": ("succeeded", "e2"), "bad": ("failed", "e2"),
                   "none": ("failed", "no pages were fetched"), "late": ("canceled", "")}
    counts = {r.job_id: (r.pages_succeeded, r.pages_failed) for r in jobs.job_counters(df).collect()}
    assert counts == {"ok": (2, 1), "bad": (0, 1), "none": (0, 0), "late": (1, 0)}


def test_job_results_keep_jobs_without_pages(spark):
    state = spark.createDataFrame([("a", "done"), ("b", "done")], "job_id string, status string")
    pages = spark.createDataFrame([("a", 1), ("a", 2), ("x", 3)], "job_id string, fetch_id bigint")
    got = jobs.job_results(state, pages).collect()
    assert sorted((r.job_id, r.fetch_id or 0) for r in got) == [("a", 1), ("a", 2), ("b", 0)]


def test_frontier(spark):
    rows = [("j", 1, "HTTP://a.com/?b=1&a=2"), ("j", 2, "http://a.com/?a=2&b=1#x"), ("k", 3, "http://a.com/?a=2&b=1")]
    df = spark.createDataFrame(rows, "job_id string, pos bigint, url string")
    got = sorted((r.job_id, r.norm_url, r.pos, r.url, r.copies) for r in frontier.dedup_frontier(df).collect())
    assert got == [("j", "http://a.com/?a=2&b=1", 1, rows[0][2], 2), ("k", "http://a.com/?a=2&b=1", 3, rows[2][2], 1)]


def test_domains_and_policy(spark):
    hosts = ["a.com", "x.A.com:80", "ba.com", "deny.a.com", "q.deny.a.com", "b.org"]
    df = spark.createDataFrame([(h, ["a.com"], ["deny.a.com"]) for h in hosts], "host string, allow array<string>, deny array<string>")
    assert [r.host for r in frontier.filter_domains(df, ["A.com"], ["deny.a.com"]).collect()] == ["a.com", "x.A.com:80"]
    assert [r.host for r in frontier.filter_domains(df, F.col("allow"), F.col("deny")).collect()] == ["a.com", "x.A.com:80"]
    assert frontier.filter_domains(df, [], []).count() == 6
    rules = spark.createDataFrame([("a.com", False, None), ("b.org", True, False)], "host string, allow_fetch boolean, allow_headless boolean")
    got = {r.host: (r.fetch_allowed, r.headless_allowed) for r in frontier.apply_policy(df, rules).collect()}
    assert got["a.com"] == (False, True) and got["b.org"] == (True, False) and got["ba.com"] == (True, True)


def test_tasks_without_a_host(spark):
    from crawlspark.operators import frontier

    df = spark.createDataFrame([("a.com",), ("b.com",), (None,)], "host string")
    left = lambda allow, deny: sorted(str(r[0]) for r in frontier.filter_domains(df, allow, deny).collect())
    assert left([], ["a.com"]) == ["None", "b.com"]
    assert left(["a.com"], []) == ["a.com"]
    assert left([], []) == ["None", "a.com", "b.com"]
