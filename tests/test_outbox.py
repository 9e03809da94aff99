"""Rows and messages: no message without its row, every page once, whatever fails."""

import json

import pytest

from crawlspark.operators import pages
from crawlspark.sources import derived, schemas, tables
from crawlspark.stored.manifest import Manifest
from crawlspark.streaming import outbox


@pytest.fixture
def source(spark, folder, tmp_path):
    derived.fetches(spark, folder).repartition(5).write.parquet(f"{tmp_path}/in")
    return lambda: tables.stream(spark, schemas.FETCH_RESPONSE, f"{tmp_path}/in", files_per_trigger=1)


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def want(spark, folder):
    stored = pages.stored_pages(derived.fetches(spark, folder))
    return rows(pages.retrievals(stored)), sorted(r["value"] for r in pages.notifications(stored, "t").collect())


@pytest.mark.parametrize("fails", ["before the rows are listed", "before the messages leave", "after they have left"])
def test_failures(spark, folder, tmp_path, source, monkeypatch, fails):
    box, sent, broken = outbox.Outbox(spark, f"{tmp_path}/table", "t", fan=2), [], {"on": True}

    def sender(messages, stream, number):
        mine = [tuple(r) for r in messages.collect()]
        there = {r["id"] for r in box.retrievals().select("id").collect()}
        assert {i for i, _ in mine} <= there  # a message's row is there before it leaves
        if broken["on"] and number == 2 and fails == "before the messages leave":
            raise OSError("broker")
        sent.extend(mine)
        if broken["on"] and number == 2 and fails == "after they have left":
            raise OSError("broker")

    real = Manifest.commit

    def commit(self, change):
        if broken["on"] and self.path.endswith("/rows") and len(sent) and fails == "before the rows are listed":
            raise OSError("storage")
        return real(self, change)

    monkeypatch.setattr(Manifest, "commit", commit)
    start = lambda: outbox.stream_crawl(source(), box, sender, f"{tmp_path}/checkpoint")
    with pytest.raises(Exception, match="broker|storage"):
        start().awaitTermination()
    listed = {r["id"] for r in box.retrievals().select("id").collect()}
    assert {i for i, _ in sent} <= listed
    broken["on"] = False
    start().awaitTermination()
    retrievals, messages = want(spark, folder)
    assert rows(box.retrievals()) == retrievals
    counted = outbox.first_deliveries(spark.createDataFrame(sent, "id string, value string"))
    assert sorted(r["value"] for r in counted.collect()) == messages
    assert len(sent) == len(messages) if fails != "after they have left" else len(sent) > len(messages)
    assert {json.loads(v)["crawl_id"] for _, v in sent} == {i for i, _ in sent}
    assert box.pending() == [] and box.send(sender) == 0
    assert len(box.rows.latest().entries) <= 3  # merged in tiers


def test_text_messages_and_no_topic(spark, folder, tmp_path, source):
    box = outbox.Outbox(spark, f"{tmp_path}/a", "t")
    outbox.stream_crawl(source(), box, outbox.text_sender(f"{tmp_path}/out"), f"{tmp_path}/c1").awaitTermination()
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/out").select("value").collect()) == want(spark, folder)[1]
    quiet = outbox.Outbox(spark, f"{tmp_path}/b", None)
    outbox.stream_crawl(source(), quiet, None, f"{tmp_path}/c2").awaitTermination()
    assert rows(quiet.retrievals()) == want(spark, folder)[0] and quiet.table().where("message IS NOT NULL").count() == 0
