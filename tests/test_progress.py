import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from crawlspark.operators import progress, runs
from crawlspark.sources import schemas

START = datetime(2024, 1, 1)
JOB = "00000000-0000-7000-8000-00000000000{}"


def event(n, job, stage, at, site="a.com", size=10, visits=1, kind="2xx", dur=5, note=None):
    return (n, job, START + timedelta(seconds=at), stage, site, "http://a.com/", size, visits, kind, dur, note)


def frame(spark, rows):
    return spark.createDataFrame(rows, schemas.PROGRESS_EVENT)


def test_validation_names_the_first_broken_rule(spark):
    nil = "00000000-0000-0000-0000-000000000000"
    rows = [
        event(0, JOB.format(1), "FETCH_DONE", 0),
        event(1, nil, "FETCH_DONE", 0, site="", dur=-1), event(2, None, "JOB_START", 0),
        (3, "j", None, "JOB_START", None, None, 0, 0, None, 0, None),
        event(4, "j", "FETCH_START", 0, site=""), event(5, "j", "FETCH_DONE", 0, site=None),
        event(6, "j", "FETCH_DONE", 0, kind=""), event(7, "j", "NOPE", 0), event(8, "j", "JOB_DONE", 0, dur=-1),
        event(9, "j", "JOB_HEARTBEAT", 0, site=None, kind=None), event(10, "j", None, 0),
    ]
    valid, rejects = progress.split_valid(frame(spark, rows))
    assert {r.event_id for r in valid.collect()} == {0, 9}
    assert {r.event_id: r.reason for r in rejects.collect()} == {
        1: "job id is required", 2: "job id is required", 3: "timestamp is required",
        4: "fetch start requires site", 5: "fetch done requires site",
        6: "fetch done requires status class", 7: 'unknown stage "NOPE"',
        8: "duration must be >= 0", 10: 'unknown stage ""',
    }


def test_fetches_collapse_into_one_delta(spark):
    rows = [
        event(0, "j", "JOB_START", 0), event(1, "j", "FETCH_DONE", 1, "example.com", 100, 1),
        event(2, "j", "FETCH_DONE", 2, "example.com", 50, 2), event(3, "j", "JOB_DONE", 3),
    ]
    deltas = progress.site_deltas(progress.foldable(frame(spark, rows))).collect()
    assert [(d.visits, d.bytes, d.latest) for d in deltas] == [(3, 150, START + timedelta(seconds=2))]


def test_statistics_and_rejects(spark):
    rows = [
        event(0, "j", "FETCH_DONE", 0, kind="2xx"), event(1, "j", "FETCH_DONE", 9, kind="6xx"),
        event(2, "j", "FETCH_DONE", 2, kind="4xx", size=0, visits=0), event(3, "j", "FETCH_DONE", 1, kind="5xx", size=7),
    ]
    deltas = progress.site_deltas(frame(spark, rows))
    assert [r.status_class for r in progress.site_delta_rejects(deltas).collect()] == ["6xx"]
    stats = progress.site_stats(deltas).collect()
    assert [tuple(r) for r in stats] == [
        ("j", "a.com", START + timedelta(seconds=1), 2, 17, 1, 0, 0, 1)]
    merged = progress.merge_site_stats(progress.site_stats(deltas), deltas).first()
    assert (merged.visits, merged.bytes_total, merged.fetch_2xx, merged.fetch_5xx) == (4, 34, 2, 2)


def replay(rows):
    """The statements a store would run, one event after the other."""
    table = {}
    for n, job, ts, stage, *_, note in sorted(rows, key=lambda r: (r[2], r[0])):
        if stage == "JOB_START":
            run = table.setdefault((job, ts), {"finished": None, "status": "running", "error": None})
            run["status"] = "running"
        elif stage in ("JOB_DONE", "JOB_ERROR"):
            for (other, _), run in table.items():
                if other == job:
                    run["finished"] = ts
                    run["status"] = "success" if stage == "JOB_DONE" else "error"
                    run["error"] = (note or None) if stage == "JOB_ERROR" else None
    return {key: (r["finished"], r["status"], r["error"]) for key, r in table.items()}


@pytest.mark.parametrize("seed", range(4))
def test_job_runs_equal_a_replay(spark, seed):
    rng = random.Random(seed)
    rows = [
        event(n, f"j{0 if rng.random() < 0.34 else rng.randrange(6)}",
              rng.choice(["JOB_START", "JOB_START", "JOB_DONE", "JOB_ERROR", "FETCH_DONE"]),
              rng.randrange(60), note=rng.choice([None, "", "boom"]))
        for n in range(300)
    ]
    got = {(r.job_id, r.started_at): (r.finished_at, r.status, r.error_message)
           for r in runs.job_runs(frame(spark, rows)).collect()}
    assert got == replay(rows)


def test_repeated_start_keeps_the_finish_time(spark):
    rows = [event(0, "j", "JOB_START", 5), event(1, "j", "JOB_ERROR", 5, note="boom"), event(2, "j", "JOB_START", 5)]
    run = runs.job_runs(frame(spark, rows)).first()
    assert (run.status, run.finished_at, run.error_message) == ("running", START + timedelta(seconds=5), "boom")


def run_table(spark, n=120):
    rows = [(f"j{i % 30}", f"j{i % 30}", START + timedelta(hours=i), None, ["running", "success", "error"][i % 3], None)
            for i in range(n)]
    return spark.createDataFrame(
        rows, "id string, job_id string, started_at timestamp_ntz, finished_at timestamp_ntz, status string, error_message string")


def test_reads(spark):
    table = run_table(spark)
    newest = runs.list_jobs(table, limit=3, offset=1).collect()
    assert [r.started_at for r in newest] == [START + timedelta(hours=h) for h in (118, 117, 116)]
    assert runs.list_jobs(table).count() == 50
    assert {r.status for r in runs.list_jobs(table, "Failure", 500).collect()} == {"error"}
    assert runs.get_job(table, "j7").count() == 4 and runs.get_job(table, "none").count() == 0
    wanted = spark.createDataFrame([("j1",), ("j1",), ("gone",)], "job_id string")
    found = runs.look_up_jobs(table, wanted).collect()
    assert sorted((r.id, r.found) for r in found) == [("gone", False)] + [("j1", True)] * 4
    for bad in ({"limit": -1}, {"limit": 0}, {"offset": -1}, {"status": "bogus"}):
        with pytest.raises(ValueError):
            runs.list_jobs(table, **bad)
    with pytest.raises(ValueError):
        runs.list_job_sites(table, limit=-1)


def test_site_pages_per_job(spark):
    rows = [(f"j{j}", f"s{s:04}", START + timedelta(seconds=s)) for j in range(2) for s in range(30)]
    stats = spark.createDataFrame(rows, "job_id string, site string, last_update timestamp_ntz")
    one = runs.list_job_sites(stats, "j1", 2, 1).collect()
    assert [r.site for r in one] == ["s0028", "s0027"]
    every = defaultdict(list)
    for r in runs.list_job_sites(stats, limit=2, offset=1).orderBy("rank").collect():
        every[r.job_id].append(r.site)
    assert every == {"j0": ["s0028", "s0027"], "j1": ["s0028", "s0027"]}


def test_documents_leave_out_what_is_absent(spark):
    row = runs.job_json(run_table(spark, 1)).first()
    assert row.job == '{"id":"j0","job_id":"j0","started_at":"2024-01-01T00:00:00Z","status":"running"}'


def test_ensure_job_runs(spark):
    table = run_table(spark, 2)
    kept = [("j0", START), ("j0", START), ("new", START), ("new", START), ("j0", START + timedelta(days=9)), ("", START), ("x", None)]
    pages = spark.createDataFrame(kept, "job_id string, job_started_at timestamp_ntz")
    got = runs.ensure_job_runs(table, pages).collect()
    assert sorted((r.id, r.started_at, r.status) for r in got) == sorted([
        ("j0", START, "running"), ("j1", START + timedelta(hours=1), "success"),
        ("new", START, "running"), ("j0", START + timedelta(days=9), "running")])


def test_all_sites_of_all_jobs_are_listed(spark):
    from crawlspark.operators import runs

    stats = spark.range(1500).selectExpr(
        "'j' || id % 2 AS job_id", "'s' || lpad(id, 5, '0') AS site", "timestamp_ntz'2024-01-01 00:00:00' AS last_update")
    got = runs.list_job_sites(stats).collect()
    assert len(got) == 1500 and max(r["rank"] for r in got) == 750
    assert all(r["rank"] == int(r["site"][1:]) // 2 + 1 for r in got)
