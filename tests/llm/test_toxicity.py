"""Folding and matching against plain searches; learning on held-out rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlspark.llm import toxicity


def test_folding_makes_spellings_meet():
    for text in ("idiot", "1D10T", "ｉｄｉｏｔ", "іdiоt", "ídiöt", "i​diot", "id!ot", "ld|0t"):
        assert toxicity.folded_words(text) == ["idiot"], text
    assert toxicity.folded_words("A! b_c, 7") == ["a", "8", "c", "t"][:0] + toxicity.folded_words("a b c 7")
    assert toxicity.folded_words(None) == toxicity.folded_words(" ... ") == []


def plain(weights, exceptions, text):
    words = toxicity.folded_words(text)
    phrases = [toxicity.folded_words(e) for e in exceptions]
    total = 0.0
    for i, word in enumerate(words):
        if any(words[j:j + len(p)] == p for p in phrases for j in range(i - len(p) + 1, i + 1) if j >= 0):
            continue
        total += max((w for s, w in weights.items() if word.startswith(s)), default=0.0)
    return total, len(words)


def test_matches_as_a_plain_search_does():
    rng = random.Random(3)
    weights = {"ab": 2.0, "abc": 3.0, "b": 1.0, "trash": 2.5, "can": 0.5}
    model = toxicity.Model(weights, (0, 1, 1), ("trash can", "b a"))
    automaton = model.automaton()
    parts = ["ab", "abcd", "b", "a", "trash", "can", "cab", "trashcan", "é", "9", ",", ""]
    for _ in range(3000):
        text = " ".join(rng.choice(parts) for _ in range(rng.randrange(0, 12)))
        got, want = toxicity.hits(automaton, text), plain(weights, model.exceptions, text)
        assert got[1] == want[1] and abs(got[0] - want[0]) < 1e-9, text
    assert toxicity.hits(toxicity.Model({}, (0, 0, 0), ()).automaton(), "a b") == (0, 2)


def test_held_out_rows_are_never_learned_from(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = [r["doc_id"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    turned = labels.withColumn("toxic", F.when(F.col("doc_id").isin(out), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.learn(docs, labels), toxicity.learn(docs, turned)
    assert a.weights == b.weights and a.curve == b.curve


def test_accuracy_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    scored = toxicity.query(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = scored.filter("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    toxic = [r for r in rows if r["toxic"]]
    clean = [r for r in rows if not r["toxic"]]
    assert np.mean([r["predicted"] for r in toxic]) > 0.9
    assert np.mean([r["predicted"] for r in clean]) < 0.01
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edges(spark, edge_docs, no_docs):
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id bigint, toxic int")
    model = toxicity.learn(edge_docs, none)
    assert {r["predicted"] for r in toxicity.score(edge_docs, model).collect()} == {0}
    labels = spark.createDataFrame([(i, int(i in (5, 8))) for i in range(10)], "doc_id bigint, toxic int")
    kept = toxicity.drop_toxic(edge_docs, labels)
    assert kept.columns == edge_docs.columns and kept.count() <= edge_docs.count()
    assert toxicity.score(no_docs, model).count() == 0
    assert toxicity.drop_toxic(no_docs, labels).count() == 0
    with pytest.raises(ValueError):
        toxicity.score(edge_docs, model, text_col="missing")
