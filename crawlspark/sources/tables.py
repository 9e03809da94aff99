"""Table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import schemas


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(schemas.PAGES).parquet(f"{folder}/pages.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(schemas.EVENTS).parquet(f"{folder}/events.parquet")


def fetches(spark: SparkSession, path: str) -> DataFrame:
    """Stored fetch responses. Jobs that do not touch `body` do not read it."""
    return spark.read.schema(schemas.FETCH_RESPONSE).parquet(path)


def fetch_rows(spark: SparkSession, path: str) -> DataFrame:
    """Stored fetch responses with all their columns, bodies as bytes. Jobs that only need hashes and sizes
    read them as they are; `pages.with_text` decodes them."""
    return spark.read.schema(schemas.FETCH_ROW).parquet(path)


def progress_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PROGRESS_EVENT).parquet(path)


def retrievals(spark: SparkSession, path: str) -> DataFrame:
    """Stored retrieval rows; filters on `partition_ts` skip folders."""
    return spark.read.schema(schemas.RETRIEVAL).parquet(path).select(*schemas.RETRIEVAL.names)


def stream(spark: SparkSession, schema, path: str,
           files_per_trigger: int | None = None) -> DataFrame:
    """A file stream with a fixed schema; the trigger size bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)
