"""Near duplicates against every pair compared, and components against a plain search."""

import random
import re

import pytest

from crawlspark.llm import lsh_forest
from crawlspark.llm.components import components


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def roots(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def expected(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids
             if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    return roots(ids, links), {i: len(s) for i, s in sets.items()}


def check(spark, table):
    rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
    got = lsh_forest.near_duplicates(table).collect()
    root, sizes = expected(rows)
    assert len(got) == len(rows)
    for row in got:
        if row["doc_id"] is None:
            assert row["component_id"] is None and row["kept"]
        else:
            assert (row["n_shingles"], row["component_id"], row["kept"]) == (
                sizes[row["doc_id"]], root[row["doc_id"]], root[row["doc_id"]] == row["doc_id"])


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.random()}"
    return words


def corpus():
    rng = random.Random(4)
    texts = []
    for base in range(12):  # groups whose members lie on both sides of the threshold
        words = [f"w{rng.randrange(10 ** 6)}" for _ in range(rng.choice([7, 30, 120, 400]))]
        for _ in range(rng.randrange(1, 25)):
            texts.append(" ".join(edited(rng, words, rng.randrange(0, max(2, len(words) // 40)))))
    shared = [f"s{i}" for i in range(60)]  # one passage in many documents
    texts += [" ".join([*shared, *(f"u{rng.random()}" for _ in range(rng.randrange(5, 60)))]) for _ in range(60)]
    texts += ["A b C d e f g h"] * 5 + ["a B c D e f g h"] * 3 + ["one two"] * 3 + ["", None, "  "] * 2
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("region", [1024, 6])
def test_links_and_components(spark, monkeypatch, region):
    monkeypatch.setattr(lsh_forest, "REGION", region)  # 6: regions are deepened and cut
    check(spark, spark.createDataFrame(corpus(), "doc_id bigint, text string"))


def test_a_crowd_of_copies_with_own_tails(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "REGION", 64)
    shared = " ".join(f"s{i}" for i in range(300))  # all pairs at 0.9
    rows = [(i, shared + "".join(f" t{i}x{j}" for j in range(16))) for i in range(2000)]
    got = lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    assert len(got) == 2000 and {r["component_id"] for r in got} == {0}


def test_places_in_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "REGION", 8)
    import numpy as np

    rng = np.random.default_rng(2)
    signature = {i: np.where(rng.random(128) < 0.9, 7, rng.integers(0, 99, 128)).astype(np.uint32) for i in range(90)}
    classes = spark.createDataFrame([(i, s.tobytes()) for i, s in signature.items()], "class_id bigint, signature binary")
    groups = {}
    for r in lsh_forest.regions(classes).collect():
        groups.setdefault(r["region"], []).append((r["class_id"], r["own"]))
    met = {(min(a, b), max(a, b)) for g in groups.values() for a, own in g for b, _ in g if own and a != b}
    assert max(map(len, groups.values())) <= 16
    for tree in range(lsh_forest.TREES):  # every class meets its neighbours of longest common prefix
        order = sorted((tuple(np.roll(s, -4 * tree)), i) for i, s in signature.items())
        for at in range(len(order) - 8):
            for near, i in order[at + 1:at + 9]:
                assert near[:4] != order[at][0][:4] or tuple(sorted((i, order[at][1]))) in met


@pytest.mark.parametrize("threshold", [80, 90])
def test_other_thresholds(spark, threshold):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows = [" ".join(words[:n]) for n in (400, 336, 370, 290)]  # copies with added paragraphs: 332/396 is 0.838
    rows += [" ".join([f"v{i}" for i in range(n)]) for n in (8, 9)]  # 4 of 5 shingles
    rows += [" ".join(edited(rng, words[100:], n)) for n in range(12)]
    rows = list(enumerate(rows))
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets
             if a < b and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    got = lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), threshold=threshold)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == roots(sorted(sets), links)


def test_estimates_let_links_pass():
    import numpy as np

    rng = np.random.default_rng(1)
    pairs = rng.integers(0, 1 << 63, (20000, 20), dtype=np.uint64)  # 17 of 20 shared
    sets = [s for p in pairs for s in (np.sort(p[:18]), np.sort(np.append(p[:17], p[18:])))]
    brief = (lsh_forest.signatures(sets) & 0xFF).astype(np.uint8)
    low = lsh_forest.THRESHOLD / 100 - lsh_forest.SLACK
    sizes = np.array([18, 19])
    assert all(lsh_forest.alike(brief[i:i + 2], sizes, 1, low, 85)[0] > 0 for i in range(0, 40000, 2))


def test_given_documents(spark, folder):
    check(spark, spark.read.parquet(f"{folder}/documents.parquet"))


def test_edges(spark, edge_docs, no_docs):
    check(spark, edge_docs)
    assert lsh_forest.near_duplicates(no_docs).count() == 0
    got = lsh_forest.drop_near_duplicates(edge_docs)
    assert got.columns == edge_docs.columns
    assert sorted(r["doc_id"] or -1 for r in got.collect()) == sorted(
        r["doc_id"] or -1 for r in edge_docs.dropDuplicates(["doc_id"]).collect() if r["doc_id"] != 9)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 400)] + [(1000, 1000 + i) for i in range(1, 200)]
    edges += [(rng.randrange(2000, 3000), rng.randrange(2000, 3000)) for _ in range(700)] + [(7, 7)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in components(
        spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)).collect()}
    root = roots({n for e in edges for n in e}, edges)
    assert got == {n: r for n, r in root.items() if n != r}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
