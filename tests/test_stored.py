"""Stored tables: versions, merges in tiers, upserts of buckets."""

import threading

import pytest
from pyspark.sql import functions as F

from crawlspark.operators import progress, runs, timeline
from crawlspark.sources import derived, schemas, tables
from crawlspark.stored import buckets, files
from crawlspark.stored.manifest import Entry, Manifest, Version
from crawlspark.streaming import deltas
from crawlspark.streaming import progress as stream


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def events(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("valid")) + "/events"
    progress.valid_events(derived.dirty_events(spark, folder)).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def parts(events, n):
    return [events.where(F.col("event_id") % n == i) for i in range(n)]


# --- versions ----------------------------------------------------------------

def test_one_writer_gets_a_number(spark, tmp_path):
    path = f"{tmp_path}/x/1.json"
    won = []
    threads = [threading.Thread(target=lambda i=i: won.append(files.create(spark, path, str(i) * 1000))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    text = files.read_text(spark, path)
    assert sum(won) == 1 and len(set(text)) == 1 and len(text) == 1000
    assert files.names(spark, f"{tmp_path}/x") == ["1.json"]
    assert files.read_text(spark, f"{tmp_path}/none") is None and files.names(spark, f"{tmp_path}/none") == []


def test_losers_try_again_on_the_newer_version(spark, tmp_path):
    manifest = Manifest(spark, str(tmp_path))
    assert manifest.latest() == Version(0, ())
    once = []

    def change(version):
        if not once:  # another writer is faster
            once.append(1)
            manifest.commit(lambda v: Version(0, (*v.entries, Entry("data/b"))))
        return Version(0, (*version.entries, Entry("data/a")), {"s": 3})

    got = manifest.commit(change)
    assert got.number == 2 and [e.folder for e in manifest.latest().entries] == ["data/b", "data/a"]
    assert manifest.latest().applied == {"s": 3}
    assert manifest.commit(lambda v: None).number == 2


# --- merges of summaries ------------------------------------------------------

FOLDS = {
    "stats": (progress.site_deltas, progress.add_deltas, stream.SITE_DELTAS, progress.site_stats),
    "running": (timeline.lifecycle, lambda m: m.hint("rebalance"), stream.MOVES, timeline.running_jobs),
}


@pytest.mark.parametrize("name", list(FOLDS))
def test_tiers_bound_folders_and_change_no_result(spark, events, tmp_path, name):
    fold, merge, schema, read = FOLDS[name]
    path, fan, n = str(tmp_path), 3, 11
    for number, part in enumerate(parts(events, n)):
        deltas.add_batch(fold(part), path, deltas.BatchId(number, "s"), merge, schema, fan)
        entries = Manifest(spark, path).latest().entries
        for level in {e.tags["level"] for e in entries}:
            assert sum(e.tags["level"] == level for e in entries) < fan
    assert len(entries) <= 2 * 3 and max(e.tags["level"] for e in entries) == 2
    assert rows(read(deltas.read_batches(spark, path, schema))) == rows(read(fold(events)))
    # batches that were merged long ago still count once
    for number, part in enumerate(parts(events, n)):
        deltas.add_batch(fold(part), path, deltas.BatchId(number, "s"), merge, schema, fan)
    assert Manifest(spark, path).latest().entries == entries
    Manifest(spark, path).vacuum(1, 0)
    live = {e.folder for e in entries}
    there = {str(p.relative_to(tmp_path)) for p in [*tmp_path.glob("stream=*/batch_id=*"), *tmp_path.glob("merged/*")]}
    assert live <= there and len(list(tmp_path.glob("merged/*"))) == sum(f.startswith("merged") for f in live)
    assert rows(read(deltas.read_batches(spark, path, schema))) == rows(read(fold(events)))


def test_readers_keep_their_version(spark, events, tmp_path):
    path, (fold, merge, schema, read) = str(tmp_path), FOLDS["stats"]
    halves = parts(events, 6)
    for number, part in enumerate(halves[:5]):
        deltas.add_batch(fold(part), path, deltas.BatchId(number, "s"), merge, schema, 100)
    before = read(deltas.read_batches(spark, path, schema))  # not run yet
    assert deltas.compact(spark, path, merge, schema, 5) == 1
    deltas.add_batch(fold(halves[5]), path, deltas.BatchId(5, "s"), merge, schema, 100)
    assert rows(before) == rows(read(fold(events.where(F.col("event_id") % 6 < 5))))
    assert rows(read(deltas.read_batches(spark, path, schema))) == rows(read(fold(events)))


def test_failed_merges_leave_nothing_that_counts(spark, events, tmp_path, monkeypatch):
    path, (fold, merge, schema, read) = str(tmp_path), FOLDS["stats"]
    for number, part in enumerate(parts(events, 4)):
        deltas.add_batch(fold(part), path, deltas.BatchId(number, "s"), merge, schema, 100)
    want = rows(read(fold(events)))
    with monkeypatch.context() as patch:
        patch.setattr(Manifest, "commit", lambda self, change: (_ for _ in ()).throw(OSError("storage")))
        with pytest.raises(OSError):
            deltas.compact(spark, path, merge, schema, 4)
    assert rows(read(deltas.read_batches(spark, path, schema))) == want
    assert len(list(tmp_path.glob("merged/*"))) == 1
    manifest = Manifest(spark, path)
    assert len(manifest.vacuum(1, 0)) == 1 and manifest.vacuum(1, 0) == []
    # two compactions at the same time: one of them counts
    real = Manifest.commit

    def slow(self, change):
        monkeypatch.setattr(Manifest, "commit", real)
        assert deltas.compact(spark, path, merge, schema, 4) == 1
        return real(self, change)

    monkeypatch.setattr(Manifest, "commit", slow)
    deltas.compact(spark, path, merge, schema, 4)
    assert len(manifest.latest().entries) == 1
    assert rows(read(deltas.read_batches(spark, path, schema))) == want


def test_streams_compact_between_batches(spark, folder, tmp_path):
    source = f"{tmp_path}/in"
    dirty = derived.dirty_events(spark, folder)
    dirty.repartition(7, "event_id").write.parquet(source)
    sinks = {"stats": stream.site_stats_sink(f"{tmp_path}/stats", 2), "runs": stream.job_runs_sink(f"{tmp_path}/runs", 2),
             "running": stream.running_jobs_sink(f"{tmp_path}/running", 2)}
    stream.run_progress(tables.stream(spark, schemas.PROGRESS_EVENT, source, files_per_trigger=1), sinks,
                        f"{tmp_path}/checkpoint").awaitTermination()
    valid = progress.valid_events(dirty)
    assert rows(stream.read_site_stats(spark, f"{tmp_path}/stats")) == rows(progress.site_stats(progress.fetch_rows(valid)))
    assert rows(stream.read_job_runs(spark, f"{tmp_path}/runs")) == rows(runs.job_runs(valid))
    assert rows(stream.read_running_jobs(spark, f"{tmp_path}/running")) == rows(timeline.running_jobs(valid))
    for name in ("stats", "runs/starts", "runs/ends", "running"):
        assert len(Manifest(spark, f"{tmp_path}/{name}").latest().entries) <= 3


# --- upserts -----------------------------------------------------------------

def test_upserts_equal_one_fold(spark, events, tmp_path):
    stats = buckets.site_stats_table(spark, f"{tmp_path}/stats", 5)
    jobs = buckets.job_runs_table(spark, f"{tmp_path}/runs", 5)
    for part in reversed(parts(events, 3)):
        stats.upsert(progress.site_stats(progress.fetch_rows(part)))
        jobs.upsert(buckets.run_facts(part))
    whole = runs.job_runs(events)
    assert rows(buckets.read_job_runs(jobs)) == rows(whole)
    assert rows(stats.read()) == rows(progress.add_site_stats(
        progress.site_stats(progress.fetch_rows(parts(events, 3)[0])).unionByName(
            progress.site_stats(progress.fetch_rows(parts(events, 3)[1]))).unionByName(
            progress.site_stats(progress.fetch_rows(parts(events, 3)[2])))))
    for job in [r[0] for r in whole.select("job_id").distinct().limit(5).collect()] + ["none"]:
        assert rows(buckets.look_up_job_runs(jobs, job)) == rows(whole.where(F.col("job_id") == job))


def listing(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_only_touched_buckets_are_written(spark, events, tmp_path):
    jobs = buckets.job_runs_table(spark, str(tmp_path), 16)
    jobs.upsert(buckets.run_facts(events))
    before, files_before = jobs.manifest.latest(), listing(tmp_path)
    job = events.where("stage = 'JOB_DONE'").first()["job_id"]
    later = events.where((F.col("job_id") == job) & (F.col("stage") == "JOB_DONE")).withColumn(
        "ts", F.col("ts") + F.expr("INTERVAL 400 DAYS")).limit(1)
    old = jobs.read()  # a reader at work
    touched = jobs.upsert(buckets.run_facts(later))
    after = jobs.manifest.latest()
    assert len(touched) == 1
    assert {e.tags["bucket"] for e in after.entries if e not in before.entries} == set(touched)
    assert len([e for e in before.entries if e in after.entries]) == len(before.entries) - 1
    assert files_before.items() <= listing(tmp_path).items()
    assert rows(buckets.read_job_runs(jobs)) == rows(runs.job_runs(events.unionByName(later)))
    assert rows(old) == rows(jobs.read(before))
    jobs.vacuum(1, 0)
    kept = {p.parent.name for p in tmp_path.rglob("*.parquet")}
    assert len(kept) == len({e.folder for e in after.entries})
    assert rows(buckets.read_job_runs(jobs)) == rows(runs.job_runs(events.unionByName(later)))


def test_batches_apply_once_and_writers_meet(spark, events, tmp_path, monkeypatch):
    stats = buckets.site_stats_table(spark, str(tmp_path), 3)
    one, two = (progress.site_stats(progress.fetch_rows(p)) for p in parts(events, 2))
    assert stats.upsert(one, deltas.BatchId(0, "s")) and stats.upsert(one, deltas.BatchId(0, "s")) == []
    want = progress.add_site_stats(one.unionByName(two).unionByName(two))
    real, met = buckets.BucketTable._merged, []

    def meanwhile(self, *args):
        written = real(self, *args)
        if not met:  # another writer changes the same buckets
            met.append(1)
            stats.upsert(two, deltas.BatchId(0, "other"))
        return written

    monkeypatch.setattr(buckets.BucketTable, "_merged", meanwhile)
    stats.upsert(two, deltas.BatchId(1, "s"))
    assert rows(stats.read()) == rows(want)
    assert stats.manifest.latest().applied == {"s": 1, "other": 0}
