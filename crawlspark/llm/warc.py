"""WARC archives of zstandard records under a shared dictionary.

A dictionary is trained on a bounded sample of records and stands in a skippable
frame at the head of every archive; each record is a frame of its own. A payload
of at least `min_bytes` that several pages share is stored once, with the page of
the smallest id, and the others become revisit records that refer to it. Tasks
write archives under fresh names into the shared folder and return manifest rows;
only archives whose rows Spark committed count, so retried tasks do no harm.

Defined results: a null page text is an empty payload; a null url leaves out the
target; pages without an id are written too, revisit an earlier equal page that
has one, and are never referred to; if no equal page has an id, each is a
response; rows that repeat the smallest id are responses alike; extra columns are
ignored; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import warnings
from urllib.parse import quote

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_run_dir
from .common import arrow, open_folder, read, saved

#: Smallest payload that is stored once; bytes of a dictionary; records and bytes of its sample; bytes of an archive.
MIN_BYTES, DICTIONARY_BYTES, SAMPLE_RECORDS, SAMPLE_BYTES, ARCHIVE_BYTES = 100, 1 << 16, 1000, 1 << 14, 1 << 28
#: The format's names and marks.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

_MANIFEST = "path string, n_records bigint, n_bytes bigint"
_RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def urn(page_id: int | None) -> str:
    """A record id from which the page id can be read back."""
    return f"<urn:uuid:{uuid.UUID(int=1 << 64 if page_id is None else page_id % (1 << 64))}>"


def page_of(record_id: str) -> int | None:
    number = uuid.UUID(record_id[len("<urn:uuid:"):-1]).int
    return None if number >> 64 else number - (1 << 64) * (number >> 63)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit, which holds the response's headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


_URL_SAFE = "!#$%&'()*+,/:;=?@[]~-._"


def parse(data: bytes) -> dict:
    """What a record says of its page; a response's payload is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(h.split(b": ")[1]) for h in http.split(b"\r\n") if h.startswith(b"Content-Length: "))
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    refers = fields.get("WARC-Refers-To")
    return {"page_id": page_of(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest,
            "record_type": kind, "refers_to": page_of(refers) if refers else None}


def train(samples: list[bytes]) -> bytes:
    """A dictionary from records; of too few to train on, their bytes themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        warnings.warn(f"no dictionary could be trained on {len(samples)} records; their bytes stand in for it", stacklevel=2)
        return b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"


def head(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def read_archive(source):
    """Yield the records of an archive, a frame at a time."""
    mark, size = struct.unpack("<II", source.read(8))
    if mark != SKIPPABLE:
        raise ValueError("no dictionary frame")
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(source.read(size)))
    waiting = source.read(1 << 17)
    while waiting:
        frame, parts = unpack.decompressobj(), []
        while not frame.eof:
            if not waiting and not (waiting := source.read(1 << 17)):
                raise ValueError("an archive ends inside a record")
            parts.append(frame.decompress(waiting))
            waiting = frame.unused_data if frame.eof else b""
        yield b"".join(parts)
        waiting = waiting or source.read(1 << 17)


def with_responses(pages: DataFrame, min_bytes: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Pages with payload, digest and the page they revisit."""
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"),
        F.coalesce(F.encode(html_col, "UTF-8"), F.lit(b"")).alias("payload")).withColumn(
        "digest", F.sha2("payload", 256))
    large = F.length("payload") >= min_bytes
    first = saved(rows.filter(large & F.col("page_id").isNotNull()).groupBy("digest").agg(
        F.min("page_id").alias("first")).withColumnRenamed("digest", "key"), "responses")
    own = F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.monotonically_increasing_id().cast("string")))
    keyed = rows.withColumn("key", F.when(large, F.col("digest")).otherwise(own))  # small ones meet nothing, evenly
    refers = F.when(F.col("page_id").isNull() | (F.col("first") != F.col("page_id")), F.col("first"))
    return keyed.join(first, "key", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> DataFrame:
    """Write the archives; a manifest row for each."""
    spark = pages.sparkSession
    folder = new_run_dir(spark, "archives")
    # long pages are cut to their first characters, for training only
    small = pages.filter(F.length(html_col) > 0).select(
        F.col(id_col).alias("i"), F.col(url_col).alias("u"), F.substring(html_col, 1, SAMPLE_BYTES // 4).alias("h")).withColumn(
        "key", F.xxhash64("i", "h"))
    keys = small.select("key").distinct().orderBy("key").limit(SAMPLE_RECORDS)  # hashes, before any text moves
    sample = small.join(F.broadcast(keys), "key").groupBy("key").agg(
        F.any_value("i").alias("i"), F.any_value("u").alias("u"), F.any_value("h").alias("h")).orderBy("key").collect()
    dictionary = spark.sparkContext.broadcast(train([
        record(r["i"], r["u"], r["h"].encode(), hashlib.sha256(r["h"].encode()).hexdigest(), None) for r in sample]))

    def run(batches):
        files, place = open_folder(folder)
        files.create_dir(place, recursive=True)
        shared = zstandard.ZstdCompressionDict(dictionary.value)
        shared.precompute_compress(level=3)
        pack = zstandard.ZstdCompressor(level=3, dict_data=shared)
        stream, name, n, size = None, "", 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    if stream is None:
                        name, n, size = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                        stream = files.open_output_stream(f"{place}/{name}")
                        stream.write(head(dictionary.value))
                    data = pack.compress(record(row["page_id"], row["url"], row["payload"], row["digest"],
                                                row["refers_to"]))
                    stream.write(data)
                    n, size = n + 1, size + len(data)
                    if size >= ARCHIVE_BYTES:
                        stream.close()
                        yield arrow([{"path": f"{folder}/{name}", "n_records": n, "n_bytes": size}], _MANIFEST)
                        stream = None
        if stream is not None:
            stream.close()
            yield arrow([{"path": f"{folder}/{name}", "n_records": n, "n_bytes": size}], _MANIFEST)

    return saved(with_responses(pages, min_bytes, id_col, url_col, html_col).mapInArrow(run, _MANIFEST), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row for every record of the archives."""
    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, place = open_folder(path)
                out = []
                with files.open_input_stream(place) as source:
                    for data in read_archive(source):
                        out.append(parse(data))
                        if len(out) == 5000:
                            yield arrow(out, _RECORDS)
                            out = []
                yield arrow(out, _RECORDS)

    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(run, _RECORDS)


def query(spark, folder) -> DataFrame:
    return read_archives(write_archives(read(spark, folder, "pages")))


ORACLE = """
WITH pages AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT payload_digest, min(page_id) AS first FROM pages WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT page_id, payload_bytes, pages.payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM pages LEFT JOIN firsts ON pages.payload_digest = firsts.payload_digest AND payload_bytes >= 100
"""
