"""Retrieval rows and completion messages of a page stream, in one commit.

A batch writes its retrieval rows, each with the message that tells of it, into one
folder, and lists the folder in the table's manifest. Messages are only made from
listed folders, so none can tell of a row that isn't there. What has been sent is
kept in a manifest of its own: a batch is noted after its messages have left, so a
failure in between sends them again, and a consumer that knows the ids it has had
counts each page once. A batch that fails before it is listed leaves nothing.

Folders are merged in tiers and sorted by hour, so the number of files follows the
size of the table, not the number of batches or hours; filters on the hour skip row
groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import pages
from ..sources import schemas
from ..stored.manifest import Manifest, Version
from . import deltas
from .progress import run_batches

#: (messages with `id` and `value`, stream, batch id) -> None
Sender = Callable[[DataFrame, str, int], None]

SCHEMA = T.StructType([
    *schemas.RETRIEVAL.fields, T.StructField("message", T.StringType()),
    T.StructField("_stream", T.StringType()), T.StructField("_batch", T.LongType()),
])


def _by_hour(rows: DataFrame) -> DataFrame:
    return rows.repartitionByRange("partition_ts", "id").sortWithinPartitions("partition_ts", "id")


class Outbox:
    """The table below `path` and the messages of topic `topic` that are still to be sent."""

    def __init__(self, spark: SparkSession, path: str, topic: str | None, fan: int = deltas.FAN):
        self.spark, self.path, self.topic, self.fan = spark, path.rstrip("/"), topic, fan
        self.rows, self.sent = Manifest(spark, f"{self.path}/rows"), Manifest(spark, f"{self.path}/sent")

    def record(self, responses: DataFrame, batch_id: int, **options) -> None:
        """Write the rows and messages of a batch; again for a batch that is listed already changes nothing."""
        stored = pages.stored_pages(responses, **options)
        message = pages.message() if self.topic else F.lit(None).cast("string")
        rows = pages.retrievals(stored, message=message).withColumns({
            "_stream": F.lit(getattr(batch_id, "stream", "0")), "_batch": F.lit(int(batch_id)).cast("bigint")})
        deltas.add_batch(rows.select(*SCHEMA.names), self.rows.path, batch_id, _by_hour, SCHEMA, self.fan)

    def pending(self) -> list[tuple[str, int]]:
        """Listed batches whose messages aren't known to have been sent."""
        upto = self.sent.latest().applied
        ranges = [(s, max(low, upto.get(s, -1) + 1), high) for e in self.rows.latest().entries
                  for s, listed in e.tags["batches"].items() for low, high in listed]
        return sorted((s, n) for s, low, high in ranges for n in range(low, high + 1))

    def send(self, sender: Sender) -> int:
        """Send what is pending, a batch at a time and in order; the number of batches."""
        if not self.topic:
            return 0
        done = 0
        for stream, number in self.pending():
            messages = self.table().where((F.col("_stream") == stream) & (F.col("_batch") == number)).select(
                "id", F.col("message").alias("value"))
            sender(messages, stream, number)
            self.sent.commit(lambda v, s=stream, n=number: Version(0, (), v.applied | {s: max(n, v.applied.get(s, -1))}))
            self.sent.vacuum(2)
            done += 1
        return done

    def table(self) -> DataFrame:
        return self.rows.read(SCHEMA)

    def retrievals(self) -> DataFrame:
        """Retrieval rows of all listed batches."""
        return self.table().select(*schemas.RETRIEVAL.names)


def stream_crawl(responses: DataFrame, outbox: Outbox, sender: Sender, checkpoint: str, *,
                 trigger: dict | None = None, **options) -> StreamingQuery:
    """Record every batch and send its messages, and those that an earlier failure left behind."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        outbox.record(batch, batch_id, **options)
        outbox.send(sender)

    return run_batches(responses, {"outbox": sink}, checkpoint, trigger=trigger)


def text_sender(path: str) -> Sender:
    """Messages as text files, one a line, in a folder per batch; a batch that is sent again replaces its folder."""
    return lambda messages, stream, number: messages.select("value").write.mode("overwrite").text(
        f"{path}/stream={stream}/batch_id={number}")


def kafka_sender(servers: str, topic: str) -> Sender:
    """Messages to Kafka, with the page's id as their key; a batch may be sent again after a failure."""
    return lambda messages, stream, number: messages.select(
        F.col("id").alias("key"), "value").write.format("kafka").option(
        "kafka.bootstrap.servers", servers).option("topic", topic).save()


def first_deliveries(messages: DataFrame) -> DataFrame:
    """What a consumer counts of messages with `id`: each page once, however often it was sent."""
    return messages.dropDuplicates(["id"])
