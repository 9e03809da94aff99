"""Encoding, token files and packing against the tokenizer itself."""

import io
import zlib

import numpy as np
import public_tokenizers
import pytest

from crawlspark.llm import packing, token_files
from crawlspark.llm.encoding import WordEncoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("path, style", [(WORD, "dropped"), (BYTE, "spaced")])
@pytest.mark.parametrize("special", [True, False])
def test_words_encode_as_texts_do(path, style, special):
    rng = np.random.default_rng(3)
    parts = [" ", "  ", "\n", "\t", "a", "B", "é", "'s", "'", ".", ",", "1", "23", "<|endoftext|>", "word", "Σ",
             "İ", "　", "\x1c", "\x85", "​", "日本", "!", "<|", "\r", "-"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(4000)] + ["", "x" * 3000]
    words = WordEncoder(path, style, special)
    want = [e.ids for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [i.tolist() for i in words.encode(texts)] == want
    assert words.encode([None])[0].tolist() == []


@pytest.mark.parametrize("bits", [True, False])
@pytest.mark.parametrize("n", [0, 1, 7, 70_000])
def test_planes_and_file_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert (token_files.from_planes(token_files.to_planes(ids, bits), n, bits) == ids).all()
    stream = io.BytesIO()
    stream.close, stream.size = lambda: None, lambda: len(stream.getvalue())
    writer = token_files.Writer(stream, bits)
    writer.add(None, ids)
    writer.add(-5, ids[:3])
    writer.close()
    got = [(d, k, np.concatenate([np.zeros(0, np.uint32), *p]).tolist()) for d, k, p in token_files.read_file(stream)]
    assert got == [(None, n, ids.tolist()), (-5, len(ids[:3]), ids[:3].tolist())]


def ids_of(tokenizer, text, end):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, folder, edge_docs, no_docs, monkeypatch):
    tokenizer = WordEncoder(WORD, "dropped").tokenizer
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    for table in (edge_docs, docs):
        manifest = token_files.write_tokens(table, WORD, "dropped", 2, bits=table is edge_docs)
        got = token_files.read_tokens(manifest).orderBy("start").collect()
        rows = table.collect()
        assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(
            (r["doc_id"] or -1, len(i), crc(i)) for r in rows for i in [ids_of(tokenizer, r["text"], 2)])
        assert [r["doc_id"] or -1 for r in got] == sorted(r["doc_id"] or -1 for r in rows)
        at = 0
        for row in got:
            assert row["start"] == at
            at += row["n_tokens"]
    assert token_files.read_tokens(token_files.write_tokens(no_docs, WORD, "dropped", 2)).count() == 0


def test_packing(spark, folder, edge_docs, no_docs):
    tokenizer = WordEncoder(BYTE, "spaced").tokenizer
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for table in (edge_docs, docs):
        pieces = packing.pack(table, BYTE)
        got = sorted(pieces.collect(), key=lambda r: (r["sequence_id"], r["offset"]))
        at = 0
        for row in got:  # gapless, full sequences in order
            assert (row["sequence_id"], row["offset"]) == divmod(at, 1024)
            at += row["length"]
        stream = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in got])
        found, at = [], 0
        for row in got:
            if row["start"] == 0:
                found.append((row["doc_id"] or -1, tuple(stream[at:at + row["doc_tokens"]])))
            at += row["length"]
        want = [(r["doc_id"] or -1, tuple(ids_of(tokenizer, r["text"], 0))) for r in table.collect()]
        assert sorted(found) == sorted(want)
        sums = packing.with_checksums(pieces).collect()
        assert sorted(r["ids_crc32"] for r in sums) == sorted(zlib.crc32(bytes(r["ids"])) for r in got)
        whole = packing.sequences(pieces).orderBy("sequence_id").collect()
        assert b"".join(bytes(r["ids"])[:4 * r["n_tokens"]] for r in whole) == stream.tobytes()
        assert all(len(r["ids"]) == 4096 for r in whole[:-1])
    assert packing.pack(no_docs, BYTE).count() == 0
