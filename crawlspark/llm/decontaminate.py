"""Benchmark decontamination by suffix arrays over the training words.

Every task sorts the suffixes of its documents, shard by shard, and binary
searches each window of the benchmark in them. `find_hits` looks each distinct
window up once and keeps merged spans and distinct items; `find_matches` gives
all locations, consecutive windows found on one diagonal joined to the longest
verbatim matches. Documents aren't shuffled; the hashed words of the benchmark go to
the tasks in blocks of bounded size.

Defined results: a null or empty text has no words and matches nothing; an item
of fewer words than a window is one window, an item without words none; repeated
rows are each judged; rows keep null ids; extra columns of either table are
ignored, or kept by `decontaminate`. Texts of any length are worked on in shards
that overlap by a window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_class, hashed_words, mix, read, saved, text_slices

WINDOW = 10
#: Words of a suffix array; words of a piece of an item; bytes of a block of items.
SHARD_WORDS, PIECE_WORDS, BLOCK_BYTES = 1 << 20, 4096, 8 << 20
#: Words are runs of 0-9, a-z and anything beyond ASCII, after lowering A-Z.
WORD = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)], inside=False)

MATCH = pa.struct([("item_id", pa.string()), ("item_word", pa.int64()),
                   ("doc_word", pa.int64()), ("words", pa.int64())])
MATCHES = "array<struct<item_id:string,item_word:bigint,doc_word:bigint,words:bigint>>"


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions of `words` ordered by the `depth` or more words that follow, by doubling ranks."""
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while step < depth and rank.max(initial=0) < n:
        later = np.zeros(n, np.int64)
        later[:n - step] = rank[step:]
        rank = np.unique(rank * (n + 2) + later, return_inverse=True)[1].astype(np.int64) + 1
        step *= 2
    return np.argsort(rank, kind="stable")


def _bound(words, order, low, high, target, depth, right):
    """First places in order[low:high] whose word at `depth` isn't below (or is above) `target`."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        value = words[order[np.minimum(mid, len(order) - 1)] + depth]
        up = open_ & ((value <= target) if right else (value < target))
        low = np.where(up, mid + 1, low)
        high = np.where(open_ & ~up, mid, high)
    return low


def search(words: np.ndarray, order: np.ndarray, flat: np.ndarray, windows: np.ndarray, size: int):
    """(low, high) places in the suffix array of the suffixes that start with each window: `size` words of `flat`."""
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(order), np.int64)
    alive = np.arange(len(windows))
    for depth in range(size):
        target, a, b = flat[windows[alive] + depth], low[alive], high[alive]
        a = _bound(padded, order, a, b, target, depth, False)
        b = _bound(padded, order, a, b, target, depth, True)
        low[alive], high[alive] = a, b
        alive = alive[a < b]
    return low, high


def test_windows(rows: list, window: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(size, words, where in them each window begins, its item, its first word there) of a block's pieces, by window size."""
    by_size: dict[int, list] = {}
    for i, row in enumerate(rows):
        words = np.frombuffer(row["hashes"], np.uint64)
        size = min(window, len(words))
        if size:
            by_size.setdefault(size, []).append((words, i, row["word"]))
    out = []
    for size, parts in by_size.items():
        count = np.array([len(w) - size + 1 for w, _, _ in parts])
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        begin = np.cumsum([0, *(len(w) for w, _, _ in parts[:-1])])
        out.append((size, np.concatenate([w for w, _, _ in parts]), place + np.repeat(begin, count),
                    np.repeat([i for _, i, _ in parts], count), place + np.repeat([w for _, _, w in parts], count)))
    return out


def matches_of(words: np.ndarray, tests: list) -> np.ndarray:
    """Rows (position, item, first item word, length): longest runs of found windows on a diagonal."""
    deepest = max((t[0] for t in tests), default=0)
    found = []
    for start in range(0, len(words), SHARD_WORDS) if deepest else ():
        shard = words[start:start + SHARD_WORDS + deepest - 1]
        order = suffix_array(shard, deepest)
        for size, flat, windows, item, at in tests:
            low, high = search(shard, order, flat, windows, size)
            count = high - low
            which = np.repeat(np.arange(len(count)), count)
            place = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(len(which))
            position = order[place]
            keep = (position < SHARD_WORDS) & (position + size <= len(shard))
            position, which = position[keep] + start, which[keep]
            found.append(np.stack([position, item[which], at[which], np.full(len(which), size)], 1))
    if not found:
        return np.zeros((0, 4), np.int64)
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0] - rows[:, 2], rows[:, 3], rows[:, 1]))]
    same = (np.diff(rows[:, 0]) == 1) & (np.diff(rows[:, 2]) == 1) & (np.diff(rows[:, 1]) == 0) & (np.diff(rows[:, 3]) == 0)
    first = np.flatnonzero(np.concatenate([[True], ~same])[:len(rows)])
    run = np.diff(np.concatenate([first, [len(rows)]]))
    out = rows[first]
    out[:, 3] += run - 1
    return out


def _found(column, tests: list, ids: list[str]):
    """Yield (row, words, matches as an array of `MATCH`) of texts."""
    for first, data, starts, ends in text_slices(column):
        hashes, at = hashed_words(data, WORD)
        doc = np.searchsorted(starts, at, "right") - 1
        counts = np.bincount(doc, minlength=len(starts))
        spaced = np.zeros(len(hashes) + len(starts), np.uint64)  # a zero between documents
        spaced[np.arange(len(hashes)) + doc] = hashes
        base = np.concatenate([[0], np.cumsum(counts + 1)])
        rows = matches_of(spaced, tests)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        of = np.searchsorted(base, rows[:, 0], "right") - 1
        edges = np.searchsorted(of, np.arange(len(starts) + 1))
        for i in range(len(starts)):
            mine = rows[edges[i]:edges[i + 1]]
            yield first + i, int(counts[i]), [
                {"item_id": ids[r[1]], "item_word": int(r[2]), "doc_word": int(r[0] - base[i]), "words": int(r[3])}
                for r in mine]


def covered(matches: list[dict]) -> int:
    """Words inside any match."""
    total = end = 0
    for start, stop in sorted((m["doc_word"], m["doc_word"] + m["words"]) for m in matches):
        total += max(0, stop - max(start, end))
        end = max(end, stop)
    return total


def item_words(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """The hashed words of items, in pieces that overlap so that no window is lost."""
    step = max(PIECE_WORDS, 2 * window)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            out = {"item_id": [], "word": [], "hashes": []}
            for first, data, starts, _ in text_slices(texts):
                hashes, at = hashed_words(data, WORD)
                edges = np.searchsorted(at, np.append(starts, len(data)))
                for i in range(len(starts)):
                    words = hashes[edges[i]:edges[i + 1]]
                    for word in range(0, max(1, len(words) - window + 1) if len(words) else 0, step):
                        out["item_id"].append(ids[first + i])
                        out["word"].append(word)
                        out["hashes"].append(words[word:word + step + window - 1].tobytes())
            yield pa.RecordBatch.from_pydict(out, pa.schema(
                [("item_id", pa.string()), ("word", pa.int64()), ("hashes", pa.binary())]))

    return benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(
        run, "item_id string, word bigint, hashes binary")


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: id, `n_words`, `n_hit` and `matches`: item, first words there and here, length.

    Items without an id are searched for as item null. The pieces of the
    benchmark are searched for block by block; a pass over the documents serves
    one block, which is collected and broadcast.
    """
    spark = docs.sparkSession
    pieces = saved(item_words(benchmark, item_col, item_text, window), "items")
    total = pieces.agg(F.sum(F.length("hashes"))).first()[0] or 0
    blocks = 1 + int(total) // BLOCK_BYTES
    block_of = F.pmod(F.xxhash64("item_id", "word"), F.lit(blocks))
    id_type = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                      F.lit(None).cast("bigint").alias("n_words"), F.lit(None).cast("bigint").alias("n_hit"),
                      F.array().cast(MATCHES).alias("matches"))
    for block in range(blocks):
        rows = pieces.filter(block_of == block).orderBy("item_id", "word").collect()
        known = spark.sparkContext.broadcast([(r["item_id"], r["word"], bytes(r["hashes"])) for r in rows])
        last = block == blocks - 1

        def run(batches, known=known, last=last):
            tests = test_windows([{"word": w, "hashes": h} for _, w, h in known.value], window)
            ids = [i for i, _, _ in known.value]
            for batch in batches:
                counts, matches = [], []
                before = batch.column("matches").to_pylist()
                for row, n, found in _found(batch.column("text"), tests, ids):
                    counts.append(n)
                    matches.append(before[row] + found)
                hit = [covered(m) for m in matches]
                texts = pa.nulls(len(counts), pa.string()) if last else batch.column("text")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), texts, pa.array(counts, pa.int64()), pa.array(hit, pa.int64()),
                     pa.array(matches, pa.list_(MATCH))], ["id", "text", "n_words", "n_hit", "matches"])

        out = out.mapInArrow(run, f"id {id_type}, text string, n_words bigint, n_hit bigint, matches {MATCHES}")
        if not last:
            out = saved(out, "matches")
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", "matches")


SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
_HITS = "n_words bigint, spans array<struct<start:bigint,stop:bigint>>, items array<string>"


def distinct_windows(tests: list) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(size, words, one place of each distinct window, edges of its items among all, those items), by window size.

    A window that many items share is searched for once; windows are told apart by 64-bit hashes.
    """
    out = []
    for size, flat, windows, item, _ in tests:
        key = np.zeros(len(windows), np.uint64)
        for depth in range(size):
            key = mix(key + mix(flat[windows + depth] + np.uint64(depth + 1)))
        _, first, group = np.unique(key, return_index=True, return_inverse=True)
        pair = np.unique(group * (int(item.max()) + 1) + item)
        owner, item = np.divmod(pair, int(item.max()) + 1)
        out.append((size, flat, windows[first], np.searchsorted(owner, np.arange(len(first) + 1)), item))
    return out


def hits_of(words: np.ndarray, tests: list):
    """For every window size: positions in `words` where a distinct window begins, and which. A position has one at most."""
    deepest = max((t[0] for t in tests), default=0)
    found: list[list] = [[] for _ in tests]
    for start in range(0, len(words), SHARD_WORDS) if deepest else ():
        shard = words[start:start + SHARD_WORDS + deepest - 1]
        order = suffix_array(shard, deepest)
        for out, (size, flat, windows, _, _) in zip(found, tests):
            low, high = search(shard, order, flat, windows, size)
            count = high - low
            which = np.repeat(np.arange(len(count)), count)
            position = order[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(len(which))]
            keep = (position < SHARD_WORDS) & (position + size <= len(shard))
            out.append((position[keep] + start, which[keep]))
    return [tuple(map(np.concatenate, zip(*out))) if out else (np.zeros(0, np.int64),) * 2 for out in found]


def _hits(column, tests: list, ids: list, before: list):
    """Yield (words, spans of hit words, distinct items) of texts, with the spans and items of earlier blocks."""
    for first, data, starts, ends in text_slices(column):
        hashes, at = hashed_words(data, WORD)
        doc = np.searchsorted(starts, at, "right") - 1
        counts = np.bincount(doc, minlength=len(starts))
        spaced = np.zeros(len(hashes) + len(starts), np.uint64)  # a zero between documents
        spaced[np.arange(len(hashes)) + doc] = hashes
        base = np.concatenate([[0], np.cumsum(counts + 1)])
        steps = np.zeros(len(spaced) + 1, np.int64)
        pairs = []
        for (size, _, _, edges, item), (position, which) in zip(tests, hits_of(spaced, tests)):
            np.add.at(steps, position, 1)
            np.add.at(steps, position + size, -1)
            met = np.unique((np.searchsorted(base, position, "right") - 1) * len(edges) + which)
            of, which = np.divmod(met, len(edges))
            count = edges[which + 1] - edges[which]
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(edges[which], count)
            pairs.append(np.unique(np.repeat(of, count) * (len(ids) + 1) + item[place]))
        cover = np.diff((np.cumsum(steps) > 0).astype(np.int8), prepend=0)
        begin, stop = np.flatnonzero(cover == 1), np.flatnonzero(cover == -1)
        owner = np.searchsorted(base, begin, "right") - 1
        cut = np.searchsorted(owner, np.arange(len(starts) + 1))
        of, item = np.divmod(np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64), len(ids) + 1)
        some = np.searchsorted(of, np.arange(len(starts) + 1))
        for i in range(len(starts)):
            old_spans, old_items = before[first + i]
            spans = [{"start": int(a - base[i]), "stop": int(b - base[i])}
                     for a, b in zip(begin[cut[i]:cut[i + 1]], stop[cut[i]:cut[i + 1]])]
            items = {ids[k] for k in item[some[i]:some[i + 1]]}
            yield int(counts[i]), _merged(old_spans + spans) if old_spans else spans, list(items.union(old_items))


def _merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for span in sorted(spans, key=lambda s: s["start"]):
        if out and span["start"] <= out[-1]["stop"]:
            out[-1]["stop"] = max(out[-1]["stop"], span["stop"])
        else:
            out.append(dict(span))
    return out


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
              text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
              block_bytes: int | None = None) -> DataFrame:
    """Per document: id, `n_words`, `spans` of words inside any window of an item, and the distinct `items`.

    What is kept of a document grows with its words and with the items found in it, not
    with their product: a window that occurs often, or in many items, is met once a place.
    """
    spark = docs.sparkSession
    pieces = saved(item_words(benchmark, item_col, item_text, window), "items")
    total = pieces.agg(F.sum(F.length("hashes"))).first()[0] or 0
    blocks = 1 + int(total) // (block_bytes or BLOCK_BYTES)
    block_of = F.pmod(F.xxhash64("item_id", "word"), F.lit(blocks))
    id_type = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(None).cast("bigint").alias("n_words"),
                      F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"),
                      F.array().cast("array<string>").alias("items"))
    for block in range(blocks):
        rows = pieces.filter(block_of == block).orderBy("item_id", "word").collect()
        known = spark.sparkContext.broadcast([(r["item_id"], r["word"], bytes(r["hashes"])) for r in rows])
        last = block == blocks - 1

        def run(batches, known=known, last=last):
            tests = distinct_windows(test_windows([{"word": w, "hashes": h} for _, w, h in known.value], window))
            ids = [i for i, _, _ in known.value]
            for batch in batches:
                before = list(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist()))
                found = list(_hits(batch.column("text"), tests, ids, before))
                words, spans, items = zip(*found) if found else ((), (), ())
                texts = pa.nulls(len(found), pa.string()) if last else batch.column("text")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), texts, pa.array(words, pa.int64()), pa.array(spans, pa.list_(SPAN)),
                     pa.array(items, pa.list_(pa.string()))], ["id", "text", "n_words", "spans", "items"])

        out = out.mapInArrow(run, f"id {id_type}, text string, {_HITS}")
        if not last:
            out = saved(out, "hits")
    return out.select(F.col("id").alias(id_col), "n_words", "spans", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, all columns as they are, without those that hold a window of an item."""
    inner = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*inner)
    whole = plain.select(F.struct(*inner).alias("row"), F.col(inner[docs.columns.index(text_col)]).alias("text"))
    found = find_hits(whole, benchmark, window, "row", "text", item_col, item_text)
    return found.filter(F.size("spans") == 0).select("row.*").toDF(*docs.columns)


def query(spark, folder) -> DataFrame:
    found = find_hits(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    items = F.array_sort("items")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
