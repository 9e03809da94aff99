import posixpath
import random

from pyspark.sql import functions as F

from crawlspark.functions import urls

NORMAL = [
    ("HTTP://EXAMPLE.COM/Path", "http://example.com/Path"),
    ("http://example.com:80/index.html", "http://example.com/index.html"),
    ("https://example.com:443/", "https://example.com/"),
    ("http://example.com:8080/path", "http://example.com:8080/path"),
    ("https://example.com/page#section1", "https://example.com/page"),
    ("https://example.com/search?q=test&a=1&b=2", "https://example.com/search?a=1&b=2&q=test"),
    ("https://example.com/path?a=1", "https://example.com/path?a=1"),
    (":%", None),
    # queries
    ("http://a.com?", "http://a.com?"),
    ("http://h/?=v&", "http://h/?=v"),
    ("http://h/??", "http://h/?%3F="),
    ("http://h/p?;", "http://h/p"),
    ("http://h/p?&&", "http://h/p"),
    ("http://h/?a=b=c&A=1", "http://h/?A=1&a=b%3Dc"),
    ("http://h?a;b&c=%zz&d", "http://h?d="),
    ("http://a.com/?b&a=x y&a=%2F*~", "http://a.com/?a=x+y&a=%2F%2A~&b="),
    ("http://h/?x=%FF&a=%e9", "http://h/?a=%E9&x=%FF"),
    ("HTTPS://A.b:443?z=1&Z=2&z=0", "https://a.b?Z=2&z=1&z=0"),
    ("http://h/?b=2&a1=1&a=0&b=1", "http://h/?a=0&a1=1&b=2&b=1"),
    ("http://h/?%62=2&a=1", "http://h/?a=1&b=2"),
    # paths
    ("/é", "/%C3%A9"),
    ("http://h/%zz", None),
    ("http://h/a b%2Fc", "http://h/a%20b/c"),
    ("http://h/a%2Fc", "http://h/a%2Fc"),
    ("not a url", "not%20a%20url"),
    ("a%3Ab c", "./a:b%20c"),
    ("*", "*"),
    ("", ""),
    ("///x", "///x"),
    # authorities
    ("http://a b/x", None),
    ("http://a:x/", None),
    ("http://h:/", "http://h:/"),
    ("http://:80/x", "http:///x"),
    ("http://", "http:"),
    ("//H/x", "//h/x"),
    ("file:///x", "file:///x"),
    ("http:/x", "http:/x"),
    ("http://[::1]:80/x", "http://[::1]/x"),
    ("http://[::1/x", None),
    ("http://U:p%40@H/", "http://U:p%40@h/"),
    ("http://u^@h/", None),
    ("http://ex%C3%84.com/", "http://ex%C3%A4.com/"),
    ("http://ex%41.com/", None),
    # opaque and broken ones
    ("mailto:x?b=1&a=2#f", "mailto:x?a=2&b=1"),
    ("a:b:c", "a:b:c"),
    ("1a:b", None),
    ("http://h/x\x7f", None),
    ("http://h/#%zz", None),
    ("http://h/#\x01", "http://h/"),
]


def test_normalize_url(values):
    got = values([u for u, _ in NORMAL], urls.normalize_url)
    assert [(u, g) for (u, _), g in zip(NORMAL, got)] == NORMAL


def test_normalizing_twice_changes_nothing(values):
    once = [u for _, u in NORMAL if u]
    assert values(once, urls.normalize_url) == once


def test_fast_path_equals_general_path(spark):
    """Random plain URLs give the same result when forced through the general rule."""
    rng = random.Random(7)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(rng.randrange(n)))
    made = [
        rng.choice(["http", "HTTPS", "Http"]) + "://" + "h" + pick("aB0.-", 6)
        + rng.choice(["", ":80", ":443", ":8080"]) + rng.choice(["", "/" + pick("aB1-_.~!$&'()*+,;=:@/[]", 9)])
        + rng.choice(["", "?" + pick("ab=&1_.~-", 12)]) + rng.choice(["", "#" + pick("a b?#/", 5)])
        for _ in range(600)
    ]
    df = spark.createDataFrame([(u,) for u in made], "u string")
    general = urls._with_parts  # the rule for any URL, without the shortcut
    plain, urls._PLAIN = urls._PLAIN, r"^\b$"
    host, urls._PLAIN_HOST = urls._PLAIN_HOST, r"^\b$"
    try:
        slow = urls.normalize_url(F.col("u")), urls.extract_host(F.col("u"))
    finally:
        urls._PLAIN, urls._PLAIN_HOST = plain, host
    assert general is urls._with_parts
    rows = df.select(
        "u", urls.normalize_url(F.col("u")).alias("a"), slow[0].alias("b"),
        urls.extract_host(F.col("u")).alias("c"), slow[1].alias("d")).collect()
    assert [r for r in rows if r.a != r.b or r.c != r.d] == []
    assert sum(r.a is not None for r in rows) > 500


def test_hosts(values):
    given = ["http://User@Ex.com:81/x", "/path", ":%", "mailto:x", "http://[::1]:8/"]
    assert values(given, urls.extract_host) == ["Ex.com:81", "unknown", "unknown", "unknown", "[::1]:8"]
    assert values(given, urls.limit_domain) == ["Ex.com", "", "unknown", "", "::1"]
    given = ["HTTP://x.com", "X.com:80/a", "httpbin.org/x", "https://A.B/", "a b"]
    assert values(given, urls.sanitize_site) == ["http", "x.com", "unknown", "a.b", "unknown"]
    given = ["Example.com:80", "", None, "  A_b ", "日本.jp", "--x__", "::"]
    assert values(given, urls.sanitize_host) == [
        "example.com_80", "unknown", "unknown", "a-b", ".jp", "x", "unknown"]


def test_blob_base(spark):
    ts = F.lit("2025-07-04 09:00:00").cast("timestamp_ntz")
    row = spark.range(1).select(
        urls.blob_base(ts, F.lit("Example.com"), F.lit("page-1"), "/crawl/").alias("a"),
        urls.blob_base(ts, F.lit(""), F.lit("page-1"), "").alias("b")).first()
    assert row.a == "crawl/202507/04/09/host=example.com/id=page-1"
    assert row.b == "202507/04/09/host=unknown/id=page-1"


def test_blob_uri(values):
    given = ["a/b", "../x", "../base/x", "a/../b", "a/../../b", "", "/abs", " ", ".", "a//b/."]
    want = []
    for path in given:
        full = posixpath.normpath(posixpath.join("/srv/base", "./" + path))
        good = path.strip() and full.startswith("/srv/base/")
        want.append(f"file://{full}" if good else None)
    assert values(given, lambda c: urls.blob_uri(c, "local", "/srv/base/")) == want
    assert values(["x", ""], lambda c: urls.blob_uri(c, "gcs", "b")) == ["gs://b/x", None]
    assert values(["x"], lambda c: urls.blob_uri(c, "memory")) == ["memory://x"]
    assert values(["x", "../x"], lambda c: urls.blob_uri(c, "local", "tmp/s")) == ["file://tmp/s/x", None]
