"""Exact search against all scores, on given, tied, clustered and odd vectors."""

import numpy as np
import pytest

from crawlspark.llm import pivot_search


def check(table, k, divisor):
    rows = {}
    for r in table.collect():
        v = r["embedding"]
        if r["vec_id"] is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        new = [int(np.floor(64 * x)) for x in v]
        rows[r["vec_id"]] = min(rows.get(r["vec_id"], new), new)
    want = []
    for q, v in rows.items():
        if q % divisor == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows.items() if i != q)[:k]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    got = pivot_search.top_k(table, k, divisor).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_given_vectors(spark, folder):
    check(spark.read.parquet(f"{folder}/embeddings.parquet"), 20, 20)


@pytest.mark.parametrize("block", [1024, 16])
def test_clusters_ties_and_edges(spark, monkeypatch, block):
    monkeypatch.setattr(pivot_search, "BLOCK", block)
    monkeypatch.setattr(pivot_search, "QUERIES", 8)
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(5, 8)) * 3
    rows = [(i, (centres[i % 5] + rng.normal(size=8) * 0.05).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8) for i in range(150)]  # many equal vectors
    rows += [(2000, None), (2001, []), (2002, [None] + [0.1] * 7), (2003, [float("nan")] * 8),
             (2004, [float("inf")] * 8), (None, [0.1] * 8), (2010, [0.3] * 3), (2020, [0.0] * 8),
             (20, [9.0] * 8), (20, [-9.0] * 8), (-40, [1.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    check(table.selectExpr("*", "1 AS id", "2 AS vector"), 20, 20)


def test_few_and_none(spark):
    table = spark.createDataFrame([(0, [1.0]), (20, [2.0])], "vec_id bigint, embedding array<float>")
    check(table, 20, 20)
    check(table.limit(1), 20, 20)
    assert pivot_search.top_k(table.filter("false")).count() == 0


def test_more_vectors_more_keys(spark, monkeypatch):
    """64 times the vectors make four times the pivots, and results stay exact."""
    assert pivot_search.pivot_count(0) == pivot_search.pivot_count(50_000) == 16
    assert pivot_search.pivot_count(64 * 50_000) == 64
    assert pivot_search.pivot_count(10 ** 15) == pivot_search.MOST_PIVOTS
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(960)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    monkeypatch.setattr(pivot_search, "BASE_VECTORS", 15)
    keys = []
    for part in (table.where("vec_id < 15"), table):
        vectors = pivot_search.integer_vectors(part, "vec_id", "embedding", 64)
        index = pivot_search.build_index(vectors, pivot_search.fit_space(vectors))
        keys.append(index.select("pivot", "ring").distinct().count())
    assert keys[1] > 8 * keys[0] and keys[1] > 150
    check(table, 20, 20)
