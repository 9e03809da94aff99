"""Repeated strings against a count of every string."""

import random
from collections import Counter

import numpy as np
import pytest

from crawlspark.llm import repeats


def expected(texts, length):
    count = Counter()
    for data in texts:
        count.update(data[i:i + length] for i in range(len(data) - length + 1))
    out = []
    for data in texts:
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if count[data[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return out


def check(table, length):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in table.select("doc_id", "text").collect()]
    want = expected([d for _, d in rows], length)
    got = repeats.remove_repeats(table, length).collect()
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], len(r["removed"]), bytes(r["kept"]))
                  for r in got) == sorted((i or -1, *w) for (i, _), w in zip(rows, want))
    return sum(w[1] for w in want)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9)))
    passage = " ".join(word() for _ in range(40))
    texts = []
    for _ in range(60):
        parts = [word() for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            a = rng.randrange(0, len(passage) - 20)
            parts.insert(rng.randrange(0, len(parts) + 1), passage[a:a + rng.randrange(5, 150)])
        texts.append(" ".join(parts))
    texts += [texts[3]] * 4 + ["ab" * 60, "a" * 90, "ab" * 30 + "c" + "ab" * 30, "", None]
    return texts


@pytest.mark.parametrize("length, block", [(40, 1 << 21), (40, 500), (12, 200), (100, 700), (5, 1 << 21)])
def test_small_strings(spark, monkeypatch, length, block):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)  # small blocks: anchors go on in the next
    monkeypatch.setattr(repeats, "SEGMENT", 64)
    table = spark.createDataFrame(list(enumerate(corpus(length))), "doc_id bigint, text string").repartition(3)
    assert check(table, length) > 0


def test_given_documents(spark, folder):
    assert check(spark.read.parquet(f"{folder}/documents.parquet"), 400) > 0


def test_edges(spark, edge_docs, no_docs):
    assert check(edge_docs, 400) > 0
    assert repeats.remove_repeats(no_docs).count() == 0


def test_buckets_are_equal_strings():
    rng = np.random.default_rng(2)
    for length in (3, 8, 9, 20, 50):
        pieces = [bytes(rng.choice(list(b"ab"), rng.integers(0, 90))) for _ in range(30)] + [b"ab" * 40] * 2
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.repeat(np.cumsum([len(p) for p in pieces]), [len(p) for p in pieces])
        bucket = repeats.refined_buckets(data, ends, length)
        seen = {}
        for i in np.flatnonzero(np.arange(len(data)) + length <= ends):
            seen.setdefault(data[i:i + length].tobytes(), set()).add(int(bucket[i]))
        assert all(len(b) == 1 for b in seen.values())
        assert len({b for s in seen.values() for b in s}) == len(seen)
