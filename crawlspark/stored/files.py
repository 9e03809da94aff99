"""Small files in shared storage, through Hadoop's file systems: any scheme that Spark can write."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds, sorted; nothing if it doesn't exist."""
    _, place, files = _hadoop(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def age_seconds(spark: SparkSession, path: str) -> float:
    """Seconds since a file or folder was changed."""
    jvm, place, files = _hadoop(spark, path)
    return (jvm.java.lang.System.currentTimeMillis() - files.getFileStatus(place).getModificationTime()) / 1000


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if there is none."""
    jvm, place, files = _hadoop(spark, path)
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Put a whole file at `path`, unless there is one: of several writers exactly one succeeds.

    The text goes to a file of its own, which is then renamed without overwriting.
    """
    jvm, place, files = _hadoop(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    files.mkdirs(place.getParent())
    stream = files.create(draft, False)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        files.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(draft, place, options)
        return True
    except Exception as error:
        if not files.exists(place):
            raise error
        files.delete(draft, False)
        return False


def remove(spark: SparkSession, path: str) -> None:
    _, place, files = _hadoop(spark, path)
    files.delete(place, True)
