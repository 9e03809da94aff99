import hashlib
import json
import random
import re

from pyspark.sql import functions as F

from crawlspark.functions import content, status


def coverage_model(body: bytes) -> int:
    """Walk from tag to tag, one byte at a time."""
    text, at, covered = body.lower(), 0, 0
    while (start := text.find(b"<script", at)) >= 0:
        opened = text.find(b">", start)
        closed = text.find(b"</script>", opened + 1) if opened >= 0 else -1
        at = closed + len(b"</script>") if closed >= 0 else len(body)
        covered += at - start
    return covered


def random_bodies(n=600):
    rng = random.Random(3)
    bits = ["<script", "<SCRIPT src=a", ">", "</script>", "</Script>", "<p>", "é", "x", "\n", "<", "/", " "]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_script_coverage(values):
    bodies = random_bodies()
    assert values(bodies, content.script_coverage) == [coverage_model(b.encode()) for b in bodies]
    dense = [len(b) > 0 and coverage_model(b.encode()) * 100 // len(b.encode()) >= 25 for b in bodies]
    assert values(bodies, content.script_dense) == dense


def test_should_promote(spark):
    script = "<html><script>var a=1;</script><p>t</p></html>"
    cases = [
        (200, "", 2048, True), (200, None, 2048, True), (200, '<div id="__next"></div>', 100, True),
        (200, script, 1000, True), (200, script, 10, False), (404, "not found", 2048, False),
        (200, "<p>x</p>", 0, False), (200, '<div ID="root">', 0, False),
        (200, '<div id="root">' + "x" * 3000, 0, True), (200, script, 0, True),
    ]
    for code, body, threshold, want in cases:
        df = spark.createDataFrame([(code, body)], "code int, body string")
        got = df.select(content.should_promote(F.col("code"), F.col("body"), threshold)).first()[0]
        assert got is want, (code, body, threshold)


def test_hash_and_size(values):
    assert values(["", "é"], content.content_hash) == [
        hashlib.sha256(b).hexdigest() for b in (b"", "é".encode())]
    assert values(["", "é"], content.body_size) == [0, 2]


def test_headers(values):
    kind = "map<string,array<string>>"
    given = [{"Content-Type": ["text/html"]}, None, {}, {"B": ["1", "2"], "A": ["<&>"]},
             {"content-type": ["", "x"]}]
    assert values(given, content.headers_json, kind) == [
        '{"Content-Type":["text/html"]}', "{}", "{}", '{"A":["\\u003c\\u0026\\u003e"],"B":["1","2"]}',
        '{"content-type":["","x"]}']
    assert values(given, content.content_type, kind)[:3] == [
        "text/html", "text/html; charset=utf-8", "text/html; charset=utf-8"]
    assert values(given, lambda c: content.content_type(c, "d"), kind)[4] == "d"
    assert values(["x-request-ID", "ETAG", "bad key", "a--b"], content.canonical_header) == [
        "X-Request-Id", "Etag", "bad key", "A--B"]


def test_meta_json(spark):
    row = spark.range(1).select(content.meta_json(
        F.lit("http://a/?a=1&b=2"), F.lit(200), F.lit(3), F.lit("ff"), F.lit("text/html"), F.lit("j"))).first()[0]
    assert row == ('{"url":"http://a/?a=1\\u0026b=2","status":200,"size":3,"sha256":"ff",'
                   '"content_type":"text/html","parent_id":"","job_uuid":"j"}')
    assert json.loads(row)["url"] == "http://a/?a=1&b=2"


def test_time_ordered_ids(spark):
    df = spark.range(200).select(
        "id", F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 1500).cast("timestamp_ntz").alias("ts"))
    ids = [r[0] for r in df.select(content.time_ordered_id(F.col("ts"), F.col("id"))).collect()]
    form = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    assert all(form.match(i) for i in ids) and len(set(ids)) == 200
    millis = [int(i.replace("-", "")[:12], 16) for i in ids]
    assert millis == [1_700_000_000_000 + i * 1500 // 1000 for i in range(200)]


def test_response_fallbacks(spark):
    row = spark.sql("SELECT '' AS a, 'https://final' AS b, 'https://req' AS c, 0 AS s, 204 AS t").select(
        content.response_url(F.col("a"), F.col("b"), F.col("c")), content.response_status(F.col("s")),
        content.response_url(F.col("c"), F.col("b"), F.col("a")), content.response_status(F.col("t")),
        content.response_url(F.lit(None).cast("string"), F.col("a"), F.col("c"))).first()
    assert tuple(row) == ("https://final", 200, "https://req", 204, "https://req")


def test_status_columns(values):
    assert values([0, 199, 200, 299, 301, 404, 599, 600, None, -1], status.status_class, "int") == [
        "other", "other", "2xx", "2xx", "3xx", "4xx", "5xx", "other", "other", "other"]
    assert values(["succeeded", "failed", "canceled", "running", "queued"], status.stage_of_status) == [
        "JOB_DONE", "JOB_ERROR", "JOB_ERROR", None, None]
    assert values([" Running ", "SUCCESS", "failure", "nope", ""], status.parse_status) == [
        "running", "success", "error", None, "running"]


def test_uuids(values):
    plain = "0189ABCD-0000-7000-8000-00000000000f"
    given = [plain, "urn:uuid:" + plain, "{" + plain + "}", plain.replace("-", ""), "job-1", "", None,
             plain[:-1], "x" + plain, plain + "\n"]
    assert values(given, status.is_uuid) == [True] * 4 + [False] * 6
    assert values(given[:4], status.canonical_uuid) == [plain.lower()] * 4
    nil = "00000000-0000-0000-0000-000000000000"
    assert values([plain, nil, "x"], status.reports_progress) == [True, False, False]
