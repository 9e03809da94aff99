"""Closing windows: emitted once, late rows counted apart, all of it the batch's rates."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from crawlspark.operators import metrics
from crawlspark.sources import derived, tables
from crawlspark.streaming import progress, windows


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def seen(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("seen")) + "/all"
    derived.observations(spark, folder).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def feed(spark, seen, path, order, n=5):
    """Files in time order, against it, or dealt at random."""
    key = F.pmod(F.xxhash64("event_id"), F.lit(n)) if order == "mixed" else F.ntile(n).over(Window.orderBy("ts", "event_id")) - 1
    parts = seen.withColumn("part", key)
    for part in range(n) if order != "backwards" else reversed(range(n)):
        parts.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(f"{path}/in")
    return tables.stream(spark, seen.schema, f"{path}/in", files_per_trigger=1)


@pytest.mark.parametrize("order", ["forward", "backwards", "mixed"])
def test_nothing_is_lost(spark, seen, tmp_path, order):
    rates = windows.ClosingRates(spark, f"{tmp_path}/out", fan=3)
    emitted = []
    sink = rates.sink()

    def watched(batch, batch_id):
        sink(batch, batch_id)
        emitted.append({tuple(r) for r in rates.closed().collect()})

    progress.run_batches(feed(spark, seen, str(tmp_path), order), {"rates": watched}, f"{tmp_path}/c").awaitTermination()
    assert rows(rates.all()) == rows(metrics.pages_rate(seen))
    for before, after in zip(emitted, emitted[1:]):
        assert before <= after  # what was emitted stays as it is
    assert emitted[-1] and len({r[:2] for r in emitted[-1]}) == len(emitted[-1])
    late = rates.late().agg(F.sum("pages")).first()[0] or 0
    last = rates.still_open().count()
    in_time = seen.where("status = 'success'").count() - late
    assert in_time > 0 and last > 0
    assert late > 0 or order == "forward"
    assert rates.closed().count() + last >= metrics.pages_rate(seen).count() - rates.late().count()


def test_restart_goes_on(spark, seen, tmp_path):
    rates = windows.ClosingRates(spark, f"{tmp_path}/out")
    source, sink, broken = feed(spark, seen, str(tmp_path), "mixed"), rates.sink(), {"on": True}

    def fragile(batch, batch_id):
        if broken["on"] and batch_id == 2:
            raise OSError("disk full")

    with pytest.raises(Exception, match="disk full"):
        progress.run_batches(source, {"rates": sink, "fragile": fragile}, f"{tmp_path}/c").awaitTermination()
    broken["on"] = False
    progress.run_batches(source, {"rates": sink, "fragile": fragile}, f"{tmp_path}/c").awaitTermination()
    assert rows(rates.all()) == rows(metrics.pages_rate(seen))
