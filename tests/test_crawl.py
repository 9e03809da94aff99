"""A crawl from submissions on: policy, job flags, promotion, missing answers."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from crawlspark.operators import crawl, pages, rules
from crawlspark.sources import schemas, tables

AT = datetime(2025, 7, 4, 9, 30)
SCRIPT = "<script>var a=1;</script>"


def submissions(spark):
    rows = [("j1", AT, ["http://A.com/1", "http://a.com/no", "not a url", "http://b.com/2"], True),
            ("j2", AT, ["http://a.com/1"], False), ("j3", AT, ["http://a.com/1"], None), ("j4", AT, [], True)]
    return spark.createDataFrame(rows, "job_id string, submitted_at timestamp_ntz, urls array<string>, headless_allowed boolean"
                                 ).withColumns({c: F.lit(None).cast("bigint") for c in (
                                     "max_depth", "max_pages", "budget_seconds")}).withColumn(
        "respect_robots", F.lit(None).cast("boolean"))


def answers(spark, tasks, body="string"):
    kind = schemas.FETCH_RESPONSE if body == "string" else schemas.FETCH_ROW
    rows = [(n, job, AT, f"http://answer/{n}", 200, None, SCRIPT if body == "string" else SCRIPT.encode(), 5, AT, False)
            + ((None, "", "") if body != "string" else ()) for n, (job, pos) in enumerate(tasks)]
    places = spark.createDataFrame([(n, pos) for n, (_, pos) in enumerate(tasks)], "fetch_id bigint, pos bigint")
    return spark.createDataFrame(rows, kind).join(places, "fetch_id")


@pytest.mark.parametrize("body", ["string", "binary"])
def test_policy_and_flags(spark, body):
    tasks = [("j1", 0), ("j1", 2), ("j1", 3), ("j2", 0), ("j3", 0)]
    probes = answers(spark, tasks, body)
    rendered = probes.drop("pos").withColumns({
        "url": F.concat("url", F.lit("/h")), "used_headless": F.lit(True),
        "body": F.lit("<html>").cast(probes.schema["body"].dataType)})
    policy = spark.createDataFrame([
        (None, "a.com", "/no", None, None, 0, False, True), (None, "b.com", "", None, None, 0, True, False),
        ("j3", "a.com", "", None, None, 0, False, True)], rules.RULES)
    stored, outcomes = crawl.crawl_results(submissions(spark), probes, rendered, policy)
    assert {(r["job_id"], r["pos"]): r["outcome"] for r in outcomes.collect()} == {
        ("j1", 0): "success", ("j1", 1): "blocked", ("j1", 2): "success", ("j1", 3): "success", ("j2", 0): "success",
        ("j3", 0): "blocked"}
    got = {(r["job_id"], r["requested_url"]): r["url"] for r in stored.collect()}
    assert got == {("j1", "http://a.com/1"): "http://answer/0/h", ("j1", "not%20a%20url"): "http://answer/1/h",
                   ("j1", "http://b.com/2"): "http://answer/2",  # the policy forbids rendering
                   ("j2", "http://a.com/1"): "http://answer/3"}  # the job does
    saved = pages.retrievals(stored)
    assert saved.count() == 4 and {r["job_started_at"] for r in saved.collect()} == {AT}


def test_tasks_without_answers_and_empty_tables(spark):
    none = answers(spark, [("j9", 0)]).where("false")
    no_rules = spark.createDataFrame([], rules.RULES)
    stored, outcomes = crawl.crawl_results(submissions(spark), none, none.drop("pos"), no_rules)
    assert stored.count() == 0 and {r["outcome"] for r in outcomes.collect()} == {"failed"} and outcomes.count() == 6
    stored, outcomes = crawl.crawl_results(submissions(spark).limit(0), none, none.drop("pos"), no_rules)
    assert stored.count() == outcomes.count() == 0


def test_bytes_that_are_no_text(spark, tmp_path):
    rows = [(1, "j", AT, "http://a/", 200, None, b"\xff\xfe<p>", 5, AT, False, b"png", "indeterminate", None),
            (2, "j", AT, "http://b/", 200, None, None, 5, AT, False, None, None, None)]
    spark.createDataFrame(rows, schemas.FETCH_ROW).write.parquet(f"{tmp_path}/rows")
    got = tables.fetch_rows(spark, f"{tmp_path}/rows")
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    text = {r["fetch_id"]: r["body"] for r in pages.with_text(got).collect()}
    assert text == {1: "��<p>", 2: None}
    assert [tuple(r) for r in pages.robots_warnings(got).collect()] == [(1, "j", "http://a/", "")]
    assert pages.stored_pages(got).where("fetch_id = 1").first()["size"] == 5
