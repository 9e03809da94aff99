import json
from datetime import datetime

from pyspark.sql import functions as F

from crawlspark.functions import content
from crawlspark.operators import pages
from crawlspark.sources import derived, schemas

AT = datetime(2025, 7, 4, 9, 30)
SCRIPT = "<script>var a=1;</script>"


def responses(spark, rows):
    full = [(n, "j", AT, url, code, headers, body, 7, AT, False) for n, url, code, headers, body in rows]
    return spark.createDataFrame(full, schemas.FETCH_RESPONSE)


def test_promoted_pages_are_replaced(spark):
    probes = responses(spark, [(n, f"http://a.com/{n}", 200, None, SCRIPT if n < 3 else "<p>") for n in range(5)])
    rendered = responses(spark, [(n, f"http://a.com/{n}/h", 200, None, "<html>") for n in (0, 1, 4)]).withColumn(
        "used_headless", F.lit(True))
    got = {r.fetch_id: (r.url, r.requested_url, r.used_headless, r.body) for r in pages.final_responses(probes, rendered).collect()}
    assert got[0] == ("http://a.com/0/h", "http://a.com/0", True, "<html>")
    assert got[2] == ("http://a.com/2", "http://a.com/2", False, SCRIPT)  # rendering failed
    assert got[4][2] is False and len(got) == 5  # not promoted
    denied = pages.final_responses(probes, rendered, allowed=F.col("fetch_id") != 0)
    assert {r.fetch_id for r in denied.where("used_headless").collect()} == {1}
    never = pages.final_responses(probes, rendered, detector=lambda status, body: F.lit(False))
    assert never.where("used_headless").count() == 0


def test_stored_page(spark):
    stored = pages.stored_pages(
        responses(spark, [(1, "http://Ex.com:81/a#f", 200, {"Content-Type": ["text/plain"]}, "é")]),
        backend="local", base="/srv", page_id=F.lit("page-1"))
    row = stored.first()
    assert row.blob_base == "crawl/202507/04/09/host=ex.com_81/id=page-1"
    assert row.html_blob == f"file:///srv/{row.blob_base}/raw.html" and row.size == 2
    saved = pages.retrievals(stored).first()
    assert saved.partition_ts == datetime(2025, 7, 4, 9) and len(saved) == 13
    assert saved.retrieval_headers == '{"Content-Type":["text/plain"]}' and saved.parent_id is None
    message = pages.notifications(stored, "t").first()
    assert message.topic == "t"
    assert json.loads(message.value) == {
        "crawl_id": "page-1", "job_id": "j", "site": "Ex.com:81", "url": "http://ex.com:81/a",
        "html_blob": row.html_blob, "meta_blob": row.html_blob.replace("raw.html", "meta.json"), "schema_version": "1"}
    assert pages.notifications(stored, None).count() == 0
    assert pages.retrievals(stored.withColumn("id", F.lit(""))).count() == 0


def test_manifest_lists_screenshots_only_where_there_are_any(spark):
    df = responses(spark, [(1, "http://a/", 200, None, "x"), (2, "http://a/", 200, None, "y")]).withColumn(
        "screenshot", F.when(F.col("fetch_id") == 1, F.lit("png").cast("binary")))
    names = sorted(r.path.rsplit("/", 1)[1] for r in pages.artifact_manifest(pages.stored_pages(df)).collect())
    assert names == ["headers.json"] * 2 + ["meta.json"] * 2 + ["raw.html"] * 2 + ["screenshot.png"]


def test_artifacts_round_trip(spark, folder, tmp_path):
    rows = derived.fetches(spark, folder)
    pages.write_artifacts(rows, str(tmp_path / "a"))
    back = pages.read_artifacts(spark, str(tmp_path / "a"))
    assert back.count() == rows.count()
    hashes = lambda df: sorted(r[0] for r in df.select(content.content_hash(F.col("body"))).collect())
    assert hashes(back) == hashes(rows)
    assert set(back.select("yyyymm").distinct().toPandas()["yyyymm"]) == {"202401"}


def test_a_repeated_run_counts_once(spark, folder, tmp_path):
    rows = pages.retrievals(pages.stored_pages(derived.fetches(spark, folder)))
    for run in ("a", "a", "b"):
        pages.write_retrievals(rows, f"{tmp_path}/r", run)
        pages.write_artifacts(derived.fetches(spark, folder), f"{tmp_path}/a", run)
    assert spark.read.parquet(f"{tmp_path}/r").count() == 2 * rows.count()
    assert pages.read_artifacts(spark, f"{tmp_path}/a").count() == 2 * rows.count()


def test_no_page_is_lost_without_an_answer(spark, folder):
    probes = derived.fetches(spark, folder)
    rendered = derived.headless_fetches(spark, folder).withColumn("screenshot", F.lit(b"png"))
    some = F.when(F.col("fetch_id") % 2 == 0, F.col("fetch_id") % 4 == 2)
    got = pages.final_responses(probes, rendered, detector=lambda status, body: some)
    assert got.count() == probes.count()
    assert got.where("screenshot IS NOT NULL").count() == got.where("used_headless").count() > 0


def test_reading_a_folder_tree(spark, tmp_path):
    base = tmp_path / "crawl/202507/04/09/host=a.com/id=p1"
    base.mkdir(parents=True)
    (base / "raw.html").write_bytes(b"<html>")
    (base / "meta.json").write_text("{}")
    row = pages.read_artifact_tree(spark, str(tmp_path)).collect()
    assert [(r.yyyymm, r.dd, r.hh, r.host, r.id, bytes(r.body), r.size) for r in row] == [
        ("202507", "04", "09", "a.com", "p1", b"<html>", 6)]


def test_retrieval_table_is_pruned_by_hour(spark, folder, tmp_path):
    path = str(tmp_path / "r")
    pages.write_retrievals(pages.retrievals(pages.stored_pages(derived.fetches(spark, folder))), path)
    table = spark.read.parquet(path).where("partition_ts = timestamp_ntz'2024-01-01 00:00:00'")
    assert table.count() > 0
    assert "PartitionFilters: [isnotnull(partition_ts" in table._jdf.queryExecution().executedPlan().toString()


def test_headers_and_duplicates(spark):
    rows = [(1, 2, "set-cookie", "b"), (1, 0, "Set-Cookie", "a"), (1, 1, "etag", "7")]
    got = pages.collect_headers(spark.createDataFrame(rows, "response_id bigint, pos int, name string, value string")).first()
    assert got.headers == {"Set-Cookie": ["a", "b"], "Etag": ["7"]}
    df = responses(spark, [(3, "u", 200, None, "x"), (2, "u", 200, None, "x"), (1, "u", 200, None, "y")])
    assert sorted((r.fetch_id, r.copies) for r in pages.dedup_by_hash(df).collect()) == [(1, 1), (2, 2)]
    assert [r.fetch_id for r in pages.list_pages(df, "j").collect()] == [1, 2, 3]
