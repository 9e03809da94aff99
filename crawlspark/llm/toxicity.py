"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lowers case, decomposes accents and wide forms, and maps homoglyphs,
digit substitutions and invisible characters, so that spellings meet; `l` and `1`
fold to `i`, which they stand for interchangeably. Patterns are word stems, found
at the beginnings of words. Stems and weights (log odds between labels) are
learned from a bounded sample of labelled rows; a logistic curve over the sum of
weights and its share of the length makes a score of 0 to 1. Exception phrases
cancel the hits inside them.

Defined results: a null or empty text has no hits and gets the score of that; a
null label or id isn't learned from; of labels that disagree the higher counts;
without any labels, every score is 0; repeated rows are each scored; extra columns
are ignored, or kept by `drop_toxic`; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, read, saved

#: Labelled rows that are learned from: those first by a hash of their ids.
SAMPLE_ROWS = 20_000
#: Lengths of stems; the most candidates, by support, that are weighed.
STEMS, CANDIDATES = range(3, 13), 20_000
#: A stem is kept with this share of the toxic rows and this many of them, and these log odds.
SUPPORT_SHARE, SUPPORT, ODDS = 0.004, 4, 2.0
THRESHOLD = 0.7
#: Phrases in which a listed word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pond scum", "heart of gold")

# Characters that look like the letters after the colons, and those that are invisible.
_ALIKE = {
    "a": "4@αа", "b": "8ьвβ", "c": "сϲ¢", "d": "ԁ", "e": "3еєε€", "g": "9", "h": "һн", "i": "1lіιıї",
    "j": "ј", "k": "кκ", "m": "м", "n": "ηп", "o": "0оοσ", "p": "рρ", "s": "5$ѕ", "t": "7тτ", "u": "υ",
    "v": "ν", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "2ζ",
}
_INVISIBLE = "­​‌‍⁠﻿"
_FOLD = {ord(c): letter for letter, alike in _ALIKE.items() for c in alike}
_FOLD |= {ord(c): None for c in _INVISIBLE} | {c: None for c in range(0x300, 0x370)}
_INNER, _WORD = re.compile(r"(?<=\w)[!|](?=\w)"), re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    if "!" in text or "|" in text:
        text = _INNER.sub("i", text)
    return text.translate(_FOLD)


def folded_words(text: str | None) -> list[str]:
    return _WORD.findall(fold(text or ""))


class Model:
    """Stems with weights, exceptions, and the curve. Its size is bounded by the sample."""

    def __init__(self, weights: dict[str, float], curve: tuple[float, float, float],
                 exceptions: tuple[str, ...] = EXCEPTIONS):
        self.weights, self.curve, self.exceptions = weights, curve, exceptions

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for stem, weight in self.weights.items():
            found.add_word(" " + stem, (len(stem) + 1, weight))
        for phrase in self.exceptions:
            plain = " ".join(folded_words(phrase))
            found.add_word(f" {plain} ", (len(plain) + 2, None))
        found.make_automaton()
        return found

    def score(self, weight: np.ndarray, words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(weight, words) @ np.array(self.curve), -30, 30)))


def features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    """One, the size of the hits, and their share of the length."""
    return np.stack([np.ones(len(weight)), np.log1p(weight), np.log1p(100 * weight / (words + 20))], 1)


def hits(automaton, text: str | None) -> tuple[float, int]:
    """Sum of weights (the largest at each word) and number of words."""
    words = folded_words(text)
    best: dict[int, float] = {}
    harmless = []
    for end, (size, weight) in automaton.iter(f" {' '.join(words)} ") if len(automaton) else ():
        start = end - size + 1
        if weight is None:
            harmless.append((start, end))
        else:
            best[start] = max(weight, best.get(start, 0.0))
    for start, end in harmless:
        for at in [a for a in best if start <= a < end]:
            del best[at]
    return sum(best.values()), len(words)


def held_out(id_col: str | Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 1 by 3."""
    id_col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int, id_col: str, text_col: str) -> DataFrame:
    """`text`, `toxic` of the labelled sample, stored; copies of a text are taken once."""
    known = labels.select(F.col("doc_id").alias("id"), "toxic").filter(
        "id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out("id"))
    sample = known.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    # `sample` has at most sample_rows rows of two numbers
    found = rows.join(F.broadcast(sample), "id").select("text", "toxic")
    return saved(found.groupBy("text").agg(F.max("toxic").alias("toxic")), "labelled")


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id",
          text_col: str = "text") -> Model:
    rows = training_rows(docs, labels, sample_rows, id_col, text_col)
    totals = dict(rows.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect())
    toxic, clean = totals.get(True, 0), totals.get(False, 0)
    if not toxic or not clean:
        return Model({}, (-30.0, 0.0, 0.0))

    def stems(text):
        return {w[:n] for w in set(folded_words(text)) for n in STEMS if n <= len(w)}

    def count(batches, only=None):
        for batch in batches:
            seen = Counter()
            for text in batch.column("text").to_pylist():
                seen.update(stems(text) if only is None else stems(text) & only.value)
            yield arrow([{"stem": s, "n": n} for s, n in seen.items()], "stem string, n bigint")

    def counted(part, only=None):
        return part.select("text").mapInArrow(lambda b: count(b, only), "stem string, n bigint").groupBy("stem").agg(
            F.sum("n").alias("n"))

    least = max(SUPPORT, SUPPORT_SHARE * toxic)
    bad = dict(counted(rows.filter("toxic > 0")).filter(F.col("n") >= least).orderBy(
        F.desc("n"), "stem").limit(CANDIDATES).collect())
    only = rows.sparkSession.sparkContext.broadcast(frozenset(bad))
    good = dict(counted(rows.filter("toxic <= 0"), only).collect())
    weights = choose_stems(bad, good, toxic, clean)
    model = Model(weights, (0.0, 0.0, 0.0))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        automaton = shared.value.automaton()
        for batch in batches:
            found = [hits(automaton, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64()),
                 batch.column("toxic").cast(pa.int32())], ["weight", "words", "toxic"])

    table = rows.mapInArrow(measure, "weight double, words bigint, toxic int").collect()  # sample_rows rows at most
    model.curve = fit_curve(*(np.array(c, float) for c in zip(*table)))
    return model


def choose_stems(bad: dict[str, int], good: dict[str, int], toxic: int, clean: int) -> dict[str, float]:
    """Stems with high log odds; a longer one only if its odds are clearly higher than its beginning's."""
    chosen: dict[str, float] = {}
    for stem in sorted(bad, key=lambda s: (len(s), s)):
        a, b = bad[stem] + 0.5, good.get(stem, 0) + 0.5
        weight = float(np.log(a / (toxic + 1)) - np.log(b / (clean + 1)))
        sure = weight - 1.64 * np.sqrt(1 / a + 1 / b)
        before = max((chosen[stem[:n]] for n in STEMS if stem[:n] in chosen and n < len(stem)), default=0.0)
        if sure >= ODDS / 2 and weight >= ODDS and weight > before + 0.7:
            chosen[stem] = weight
    return chosen


def fit_curve(weight: np.ndarray, words: np.ndarray, toxic: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps, with a small penalty."""
    x, y, w = features(weight, words), (toxic > 0).astype(float), np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - 0.01 * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(3)
        step = np.linalg.solve(bend, slope)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(map(float, w))


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of `docs`, in order, in a struct `row` (c0, c1, ...), with `toxicity` and `predicted`."""
    inner = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*inner).select(F.struct(*inner).alias("row"),
                                    F.col(inner[docs.columns.index(text_col)]).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        automaton = model.automaton()
        for batch in batches:
            found = [hits(automaton, t) for t in batch.column("text").to_pylist()]
            value = model.score(np.array([w for w, _ in found], float), np.array([n for _, n in found], float))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(value), pa.array((value >= threshold).astype(np.int32))],
                ["row", "toxicity", "predicted"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, toxicity double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               threshold: float = THRESHOLD) -> DataFrame:
    """The documents that aren't predicted toxic, all columns as they are."""
    scored = score(docs, learn(docs, labels, id_col=id_col, text_col=text_col), text_col, threshold)
    return scored.filter("predicted = 0").select("row.*").toDF(*docs.columns)


def query(spark, folder) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    model = learn(docs, read(spark, folder, "labels"))
    return score(docs, model).select(
        F.col("row.c0").alias("doc_id"), held_out("row.c0").alias("held_out"), F.col("toxicity").alias("score"),
        "predicted")
