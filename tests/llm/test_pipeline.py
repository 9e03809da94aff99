"""Every stage of the pipeline against a plain version, on its own input; and all of them together."""

import public_tokenizers
import pytest
import test_decontaminate
import test_lsh_forest
import test_toxicity
import test_tokens

import corpus_pipeline
from crawlspark.llm import pii, toxicity
from crawlspark.llm.common import saved
from crawlspark.llm.encoding import WordEncoder


@pytest.fixture(scope="module")
def stored(spark, folder):
    """The input of each stage and the output of the last."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, folder), f"test-{name}")
        out.append(docs)
    return out


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns_stay(stored):
    assert all(df.columns == stored[0].columns for df in stored[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]


def test_toxic_documents_go(spark, folder, stored):
    model = toxicity.learn(stored[0], spark.read.parquet(f"{folder}/labels.parquet"))
    import numpy as np

    for r in stored[0].collect():
        weight, words = test_toxicity.plain(model.weights, model.exceptions, r["text"])
        score = model.score(np.array([weight]), np.array([float(words)]))[0]
        assert (r["doc_id"] in by_id_cache(stored[1])) == (score < toxicity.THRESHOLD)


_cache = {}


def by_id_cache(df):
    return _cache.setdefault(id(df), by_id(df))


def test_one_of_each_group_stays(stored):
    root, _ = test_lsh_forest.expected([(r["doc_id"], r["text"]) for r in stored[1].collect()])
    assert set(by_id(stored[2])) == {n for n, r in root.items() if n == r}
    assert stored[2].count() == len(by_id(stored[2]))


def test_benchmark_passages_go(spark, folder, stored):
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = test_decontaminate.expected([(r["doc_id"], r["text"]) for r in stored[2].collect()], items, 10)
    assert set(by_id(stored[3])) == {doc for doc, _, hit, _ in want if not hit}


def test_personal_data_is_masked(stored):
    before, after = by_id(stored[3]), by_id(stored[4])
    assert set(before) == set(after)
    field = pii.fit(stored[3])
    texts = [r["text"] for r in before.values()]
    base = [pii.base_spans(t) for t in texts]
    added = pii.added_spans(field, texts, base)
    for row, text, b, a in zip(before.values(), texts, base, added):
        got = after[row["doc_id"]]
        assert got["text"] == pii.masked(text, b + a)
        assert not pii.base_spans(got["text"])
        assert got["n_chars"] == (len(got["text"]) if b + a else row["n_chars"])


def test_all_kept_documents_are_packed(spark, folder, stored):
    tokenizer = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"), "spaced").tokenizer
    want = {r["doc_id"]: len(test_tokens.ids_of(tokenizer, r["text"], 0)) for r in stored[4].collect()}
    pieces = stored[5].collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in pieces} == want
    assert sum(r["length"] for r in pieces) == sum(want.values())
    again = corpus_pipeline.run(spark, folder).collect()
    total = lambda rows: sorted((r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0)
    assert total(again) == total(pieces)
