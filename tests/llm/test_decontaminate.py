"""Decontamination against a search for every window."""

import random
import re

import pytest

from crawlspark.llm import decontaminate as d


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def expected(docs, items, window):
    known = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            known.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in known}:
            for i in range(len(w) - n + 1):
                if (which := known.get(tuple(w[i:i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= which
        out.append((doc, len(w), len(hit), found))
    return out


def check(docs, benchmark, window):
    got = d.find_matches(docs, benchmark, window).collect()
    want = expected([(r["doc_id"], r["text"]) for r in docs.collect()],
                    [(None if r["item_id"] is None else str(r["item_id"]), r["text"]) for r in benchmark.collect()], window)
    rows = [(r["doc_id"] or -1, r["n_words"], r["n_hit"], sorted({str(m["item_id"]) for m in r["matches"]})) for r in got]
    assert sorted(rows) == sorted((i or -1, n, h, sorted(map(str, f))) for i, n, h, f in want)
    for block in (None, 200):  # in one block, and in many
        hits = d.find_hits(docs, benchmark, window, block_bytes=block).collect()
        rows = [(r["doc_id"] or -1, r["n_words"], sum(s["stop"] - s["start"] for s in r["spans"]),
                 sorted(map(str, r["items"]))) for r in hits]
        assert sorted(rows) == sorted((i or -1, n, h, sorted(map(str, f))) for i, n, h, f in want)
        assert all(len(set(r["items"])) == len(r["items"]) for r in hits)
    return got


@pytest.mark.parametrize("window, shard, block", [(10, 1 << 20, 8 << 20), (4, 50, 8 << 20), (4, 1 << 20, 300)])
def test_small_tables(spark, monkeypatch, window, shard, block):
    monkeypatch.setattr(d, "SHARD_WORDS", shard)
    monkeypatch.setattr(d, "BLOCK_BYTES", block)
    monkeypatch.setattr(d, "PIECE_WORDS", 9)
    rng = random.Random(window + shard)
    text = lambda n: " ".join(rng.choice(["a", "b", "C", "é", "x9"]) for _ in range(n))
    items = [(i, text(rng.randrange(0, 40))) for i in range(12)] + [(None, "a b c d e f g h i j k"), (99, None), (98, "b, C")]
    docs = [(i, text(rng.randrange(0, 200))) for i in range(40)] + [(50, items[3][1] + " zz " + items[3][1]), (51, None)]
    check(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3),
          spark.createDataFrame(items, "item_id bigint, text string"), window)


def test_given_tables(spark, folder):
    got = check(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"), 10)
    assert any(r["n_hit"] for r in got)


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "x a b c d e y b c d z")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "q a B c, d e f")], "item_id bigint, text string")
    found = d.find_matches(docs, items, 3).first()["matches"]
    assert sorted(map(tuple, found)) == [("7", 1, 1, 5), ("7", 2, 7, 3)]


def test_edges(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "Two three four five six seven eight nine ten eleven and on")],
                                  "item_id bigint, text string")
    check(edge_docs, items, 10)
    kept = d.decontaminate(edge_docs, items)
    assert kept.columns == edge_docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(
        r["doc_id"] or -1 for r in edge_docs.collect() if not (r["text"] or "").startswith("one two"))
    assert d.find_matches(no_docs, items).count() == 0
    assert d.decontaminate(edge_docs, items.filter("false")).count() == edge_docs.count()


def test_common_windows_take_no_product(spark):
    """1,000 items of one common word, in a text of thousands of it: one span, each item once."""
    items = spark.createDataFrame([(i, "spam " * 12) for i in range(1000)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "spam " * 5000), (2, "ham " * 50)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in d.find_hits(docs, items).collect()}
    assert [tuple(s) for s in got[1]["spans"]] == [(0, 5000)] and sorted(map(int, got[1]["items"])) == list(range(1000))
    assert not got[2]["spans"] and not got[2]["items"]
    import numpy as np

    words = np.full(5000, 7, np.uint64)
    rows = [{"word": 0, "hashes": np.full(12, 7, np.uint64).tobytes()} for _ in range(1000)]
    tests = d.distinct_windows(d.test_windows(rows, 10))
    assert len(tests[0][2]) == 1
    assert sum(len(p) for p, _ in d.hits_of(words, tests)) == 4991  # a row for a place, whatever the number of items


def test_shards_overlap(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    words = rng.integers(1, 4, 3000).astype(np.uint64)
    rows = [{"word": 0, "hashes": words[i:i + 9].tobytes()} for i in range(0, 2900, 50)]
    tests = d.distinct_windows(d.test_windows(rows, 6))
    whole = [sorted(zip(*map(np.ndarray.tolist, f))) for f in d.hits_of(words, tests)]
    monkeypatch.setattr(d, "SHARD_WORDS", 64)
    assert [sorted(zip(*map(np.ndarray.tolist, f))) for f in d.hits_of(words, tests)] == whole and whole[0]
