"""Merge replay against the library, on given texts, odd texts and odd tables of ranks."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from crawlspark.llm import merge_replay

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocab():
    return merge_replay.vocabulary(PATH)


@pytest.fixture(scope="module")
def library(vocab):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks,
                             special_tokens={})


def random_texts(seed, n=400):
    rng = random.Random(seed)
    parts = ["a", "aa", "aaaa", "the", " the", "  ", "\n", "\n\n", "\t", "'s", "'S", "é", "日本", "\U0001F600", "1",
             "2024", "...", "!?", "<|endoftext|>", " ", " ", "\x00", "ing", "Z" * 40]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("word_bytes", [40, 1 << 23])
def test_texts_encode_as_by_the_library(vocab, library, word_bytes):
    texts = [None, "", *random_texts(3), "a" * 3000, "ab" * 2000]
    got = list(merge_replay.encode_texts(iter(texts), vocab, public_tokenizers.PATTERN, word_bytes))
    assert len(got) == len(texts)
    for text, ids in zip(texts, got):
        assert ids.tolist() == library.encode_ordinary(text or "")
        assert vocab.decode(ids.astype("int64")) == (text or "").encode()


def test_long_texts_fill_several_blocks(vocab, library, monkeypatch):
    monkeypatch.setattr(merge_replay, "STEP", 50)
    texts = ["short", " ".join(random_texts(5, 200)), "", "and on", " ".join(random_texts(6, 100))]
    for word_bytes in (30, 1000, 1 << 23):
        got = list(merge_replay.encode_texts(iter(texts), vocab, public_tokenizers.PATTERN, word_bytes))
        assert [i.tolist() for i in got] == [library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("seed", range(12))
def test_any_table_of_ranks(seed):
    """Ranks in an order that no training makes: new pairs may rank below the merge that made them."""
    rng = random.Random(seed)
    strings = {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 6))).encode() for _ in range(40)}
    ranks = {bytes([b]): b for b in range(256)}
    order = sorted(strings) if seed % 3 else sorted(strings, key=len)
    rng.shuffle(order) if seed % 2 else None
    ranks |= {s: 256 + i for i, s in enumerate(order)}
    vocab = merge_replay.Vocabulary(ranks)
    library = tiktoken.Encoding("own", pat_str="[a-z]+", mergeable_ranks=ranks, special_tokens={})
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    ids, count = merge_replay.replay([w.encode() for w in words], vocab)
    at = 0
    for word, n in zip(words, count):
        assert ids[at:at + n].tolist() == library.encode_ordinary(word)
        at += n
    assert at == len(ids)


def test_bytes_must_be_in_the_vocabulary():
    with pytest.raises(ValueError):
        merge_replay.Vocabulary({b"a": 0})


def test_query(spark, folder, library):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in merge_replay.query(spark, folder).collect()}
    assert len(got) == len(rows)
    for row in rows:
        ids = library.encode_ordinary(row["text"] or "")
        mine = got[row["doc_id"]]
        assert mine["n_tokens"] == len(ids)
        assert mine["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert mine["decoded_sha256"] == hashlib.sha256((row["text"] or "").encode()).hexdigest()


def test_edges(edge_docs, no_docs, library):
    renamed = edge_docs.selectExpr("*", "1 AS ids", "2 AS decoded")
    got = merge_replay.decode(merge_replay.encode(renamed, PATH, public_tokenizers.PATTERN), PATH).collect()
    want = [(r["doc_id"], tuple(library.encode_ordinary(r["text"] or "")), (r["text"] or "").encode())
            for r in edge_docs.collect()]
    key = repr
    assert sorted(((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in got), key=key) == sorted(want, key=key)
    assert merge_replay.encode(no_docs, PATH, public_tokenizers.PATTERN).count() == 0
