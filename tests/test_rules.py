"""Rules against a plain search of the deciding rule for every task."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from crawlspark.operators import frontier, rules
from crawlspark.plans import queries
from crawlspark.sources import derived, schemas

TASK = "job_id string, pos bigint, url string, host string, depth bigint"


def plain(task, table):
    job, _, url, host, depth = task
    labels = [x for x in re.sub(r":[0-9]*$", "", host or "").lower().split(".") if x]
    found = re.match(r"[a-z]+://[^/?#]*([^?#]*)", url or "")
    segments = [x for x in found[1].split("/") if x] if found else []
    best = None
    for r_job, r_host, r_path, low, high, priority, fetch, headless in table:
        own = [x for x in re.sub(r":[0-9]*$", "", r_host or "").lower().split(".") if x]
        path = [x for x in (r_path or "").split("/") if x]
        holds = (r_job in (None, job) and (not own or labels[-len(own):] == own) and segments[:len(path)] == path
                 and (low is None or depth >= low) and (high is None or depth <= high))
        if holds:
            rank = (priority or 0, len(own), len(path), r_job is not None, low is not None or high is not None,
                    fetch is False, headless is False)
            best = max(best, rank) if best else rank
    return (not best[5], not best[6]) if best else (True, True)


@pytest.mark.parametrize("seed", range(3))
def test_the_most_specific_rule_decides(spark, seed):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    hosts = [None, "", "a.com", "b.a.com", "c.b.a.com", "com", "xa.com", "B.A.com:8080", "d.org"]
    paths = ["", "/", "/x", "/x/y", "/x/y/z", "/xy", "/x//y"]
    table = [(pick(None, None, "j1", "j2"), pick(*hosts), pick(None, *paths), pick(None, None, 1), pick(None, None, 2),
              pick(None, 0, 0, 1), pick(True, False, None), pick(True, False)) for _ in range(25)]
    tasks = [(pick("j1", "j2", "j3"), i, pick(None, "not a url", *[f"https://{pick(*hosts)}{p}{pick('', '?q/r', '#f')}" for p in paths]),
              pick(*hosts), rng.randrange(4)) for i in range(300)]
    got = rules.decide(spark.createDataFrame(tasks, TASK).withColumn("_host", F.lit(1)).withColumn("priority", F.lit(2)),
                       spark.createDataFrame(table, rules.RULES))
    assert got.count() == len(tasks)
    assert {r["pos"]: (r["fetch_allowed"], r["headless_allowed"]) for r in got.collect()} == {
        t[1]: plain(t, table) for t in tasks}


def test_no_rules_allow_all(spark):
    tasks = spark.createDataFrame([("j", 1, "https://a/b", "a", 0)], TASK)
    got = rules.decide(tasks, spark.createDataFrame([], rules.RULES)).first()
    assert (got["fetch_allowed"], got["headless_allowed"]) == (True, True)
    assert rules.decide(tasks.limit(0), spark.createDataFrame([(None, "a", "", None, None, 0, False, True)], rules.RULES)).count() == 0


def test_domain_lists_mean_what_the_filter_means(spark, folder):
    tasks = derived.tasks(spark, folder).select("job_id", "pos", "url", "host", "depth")
    lists = spark.createDataFrame(
        [(None, "example.com", True), (None, "EXAMPLE.org", True), (None, "therou.example.com", False)],
        "job_id string, domain string, allow boolean")
    want = frontier.filter_domains(tasks, ["example.com", "EXAMPLE.org"], ["therou.example.com"])
    got = rules.decide(tasks, rules.of_domain_lists(lists)).where("fetch_allowed")
    key = ["job_id", "pos"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))
    assert 0 < got.count() < tasks.count()


def test_no_list_of_rules_in_the_plan(spark):
    table = spark.range(200_000).select(
        F.lit(None).cast("string").alias("job_id"), F.concat(F.lit("h"), F.col("id"), F.lit(".com")).alias("host"),
        F.lit("").alias("path"), F.lit(None).cast("bigint").alias("min_depth"), F.lit(None).cast("bigint").alias("max_depth"),
        F.lit(0).alias("priority"), (F.col("id") % 2 == 0).alias("allow_fetch"), F.lit(True).alias("allow_headless"))
    tasks = spark.range(1000).select(
        F.lit("j").alias("job_id"), F.col("id").alias("pos"), F.lit("").alias("url"),
        F.concat(F.lit("w.h"), F.col("id"), F.lit(".com")).alias("host"), F.lit(0).cast("bigint").alias("depth"))
    decided = rules.decide(tasks, table)
    plan = decided._jdf.queryExecution().toString()
    assert len(plan) < 60_000 and "NestedLoop" not in plan and "Cartesian" not in plan and "h17.com" not in plan
    assert decided.where("fetch_allowed").count() == 500


def test_tasks_are_worked_out_once(spark, tmp_path):
    path = str(tmp_path / "frontier")
    spark.createDataFrame([("j", i, f"https://a.com/{i}", "a.com", 0) for i in range(9)], TASK).write.parquet(path)
    decided = rules.decide(spark.read.parquet(path), spark.createDataFrame(
        [(None, "a.com", f"/{i}", None, None, 0, i % 2 == 0, True) for i in range(4)], rules.RULES))
    physical = decided._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan" in line and "url#" in line for line in physical.splitlines()) == 1
    assert {r["pos"] for r in decided.where("NOT fetch_allowed").collect()} == {1, 3}


def test_rules_of_pages(spark, tmp_path):
    urls = ["http://m.Shop.example.com:80/en//7?a=b", "not a url", None, "https://u@x.org", "https://x.org/p/"]
    spark.createDataFrame([(i * 9, u, "") for i, u in enumerate(urls)] * 2, schemas.PAGES).write.parquet(
        str(tmp_path / "pages.parquet"))
    want = []
    for n, url in [(i * 9, u) for i, u in enumerate(urls)] * 2:
        found = re.match(r"[a-z]+://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)", url or "")
        site, path = found.groups() if found else (None, None) if url is None else ("", "")
        for i in range(400):
            host = site and re.sub(r"^[^.]*[.]", "", site) if i % 4 == 3 else site
            below = "" if i < 2 else path if i < 4 or path is None else f"{path}/r{i}"
            want.append((f"{derived.JOB_PREFIX}{n * 7 % 100:012}" if i % 3 == 1 else None, host, below,
                         1 if (n + i) % 5 == 0 else None, None, int((n + i) % 41 == 0), (n + i) % 3 != 0, (n * 3 + i) % 4 != 0))
    assert Counter(map(tuple, queries._rules(spark, str(tmp_path)).collect())) == Counter(want)
