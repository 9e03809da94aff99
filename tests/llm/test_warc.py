"""Archives: exact round trip, shared payloads, edge rows."""

import hashlib
import io

import pytest
from pyspark.sql import functions as F

from crawlspark.llm import warc


def test_record_round_trip():
    digest = hashlib.sha256("é\r\n\r\nb".encode()).hexdigest()
    got = warc.parse(warc.record(-3, "http://a b/\r\nX: y", "é\r\n\r\nb".encode(), digest, None))
    assert got == {"page_id": -3, "payload_bytes": 7, "payload_digest": digest, "record_type": "response",
                   "refers_to": None}
    got = warc.parse(warc.record(None, None, "é\r\n\r\nb".encode(), digest, 2 ** 62))
    assert (got["page_id"], got["payload_bytes"], got["record_type"], got["refers_to"]) == (
        None, 7, "revisit", 2 ** 62)


@pytest.mark.parametrize("n", [0, 1, 400])
def test_archive_round_trip(n):
    import zstandard

    samples = [(f"WARC/1.1 record {i} " * (i % 7 + 1)).encode() + bytes([i % 256]) for i in range(n)]
    dictionary = warc.train(samples)
    pack = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    big = [*samples, b"", bytes(300_000), bytes(range(256)) * 2000]
    data = warc.head(dictionary) + b"".join(map(pack.compress, big))
    assert list(warc.read_archive(io.BytesIO(data))) == big


def test_pages(spark):
    page, other = "<p>" + "é" * 60, "<p>" + "b" * 120
    rows = [(5, "u", page), (2, None, page), (9, "v", page), (None, "w", page), (2, "x", page),
            (1, "s", "short"), (3, "t", "short"), (4, "n", None), (6, "e", ""), (None, None, None),
            (None, "o", other), (None, "p", other), (2 ** 60 + 1, "q", "z" * 200_000)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1))
    got = warc.read_archives(warc.write_archives(table)).collect()
    want = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        same = [i for i, _, h in rows if h == html and i is not None]
        refers = min(same) if len(data) >= 100 and same and min(same) != page_id else None
        want.append((page_id, len(data), hashlib.sha256(data).hexdigest(),
                     "response" if refers is None else "revisit", refers))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert warc.read_archives(warc.write_archives(table.filter("false"))).count() == 0


def test_dictionary_of_long_pages(spark):
    import struct

    rows = [(i, f"http://h/{i}", "".join(f"<p class=x>{(i * j) % 977} entry {j}</p>" for j in range(400))) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    manifest = warc.write_archives(pages)
    for row in manifest.collect():
        files, place = warc.open_folder(row["path"])
        with files.open_input_stream(place) as f:
            assert struct.unpack("<II", f.read(8))[1] > 1000
    assert warc.read_archives(manifest).filter("record_type = 'response'").count() == 300
