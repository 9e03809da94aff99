"""Fetched pages as a stream: retrieval rows and completion messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import functions as F

from ..operators import pages
from .progress import run_batches


def stream_retrievals(responses: DataFrame, path: str, checkpoint: str, *,
                      trigger: dict | None = None, **options) -> StreamingQuery:
    """Add retrieval rows to a table partitioned by hour.

    A batch is a run of the table: written again after a failure, it counts
    once, and its hours come out in few files.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = pages.retrievals(pages.stored_pages(batch, **options))
        pages.write_retrievals(rows, path, f"{batch_id.stream}-{int(batch_id)}")

    return run_batches(responses, {"retrievals": sink}, checkpoint, trigger=trigger)


def stream_notifications(responses: DataFrame, topic: str, checkpoint: str, *,
                         path: str | None = None, kafka_servers: str | None = None,
                         trigger: dict | None = None, **options) -> StreamingQuery:
    """Send completion messages to Kafka, or to text files with a message per line."""
    messages = pages.notifications(pages.stored_pages(responses, **options), topic)
    if kafka_servers:
        writer = messages.writeStream.format("kafka").option("kafka.bootstrap.servers", kafka_servers)
    else:
        writer = messages.select("value").writeStream.format("text").option("path", path)
    return (
        writer.outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
