"""Byte-level BPE by replaying merges over a corpus, and its decoding.

A task splits its texts into words and gives every distinct word one place in a
long array of byte tokens, linked to left and right neighbours. An inverted index
holds, for the rank of every pair of neighbours, the places where it stands. The
merges are then replayed in the order of their ranks, each once and at all its
places in all words together; only the neighbours of merged places get new pairs,
which go into the index. Merges never cross words, so the blocks of a corpus that
tasks replay don't depend on each other and nothing is shuffled. A word in which a
merge makes a pair of a smaller rank (no vocabulary made by training has one, but
a table of ranks may) is encoded on its own, lowest rank first.

Defined results: a null or empty text has no ids; a text of any length is split
whole, in blocks of words; repeated rows, ties and rows without an id are encoded
like any others; columns other than the two named are ignored; an empty table
gives no rows. Every byte must be in the vocabulary.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

#: Letters of distinct words that a task keeps, and the words of texts that it holds at once.
WORD_BYTES, STEP = 3 << 20, 1 << 20

_NONE = np.int64(1) << 40


class Vocabulary:
    """Ranks of byte strings, and the rank that every pair of them merges to."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"bytes without a rank: {missing}")
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.size = max(ranks.values()) + 1
        keys, values = [], []
        for whole, rank in ranks.items():
            for cut in range(1, len(whole)):
                a, b = ranks.get(whole[:cut]), ranks.get(whole[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    values.append(rank)
        keys, values = np.array(keys, np.int64), np.array(values, np.int64)
        order = np.argsort(keys)
        self.keys, self.values = np.append(keys[order], np.iinfo(np.int64).max), np.append(values[order], _NONE)
        text = [b""] * self.size
        for whole, rank in ranks.items():
            text[rank] = whole
        self.ends = np.cumsum([len(t) for t in text])
        self.bytes = np.frombuffer(b"".join(text), np.uint8)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of every pair, `_NONE` where it doesn't merge."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], _NONE)

    def decode(self, ids: np.ndarray) -> bytes:
        out = []
        for at in range(0, len(ids), STEP):
            part = ids[at:at + STEP]
            stop = self.ends[part]
            size = stop - np.where(part > 0, self.ends[part - 1], 0)
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(stop - size, size)
            out.append(self.bytes[place].tobytes())
        return b"".join(out)


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file of base64 strings and ranks; a process keeps one, whose size is the file's."""
    with open(path, "rb") as file:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)})


def one_by_one(word: bytes, vocab: Vocabulary) -> list[int]:
    """Merge the pair of the lowest rank, the leftmost of them, until none is left."""
    parts = [word[i:i + 1] for i in range(len(word))]
    while True:
        least = min(((vocab.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:]))
                     if a + b in vocab.ranks), default=None)
        if least is None:
            return [vocab.ranks[p] for p in parts]
        i = least[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def replay(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, one after the other, and how many each has. Words aren't empty."""
    whole = np.array([vocab.ranks.get(w, -1) for w in words], np.int64)
    size = np.array([len(w) for w in words], np.int64)
    byte = np.frombuffer(b"".join(words), np.uint8)
    n = len(byte)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), size)
    last = np.cumsum(size) - 1
    token = vocab.of_byte[byte]
    left, right = np.arange(-1, n - 1, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32)
    right[last] = -1
    left[last - size + 1] = -1
    alive = whole[owner] < 0
    rank = np.full(n, _NONE)
    pairs = np.flatnonzero(alive & (right >= 0))
    rank[pairs] = vocab.merged(token[pairs], token[pairs + 1])
    odd = np.zeros(len(words), bool)

    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def add(places: np.ndarray) -> None:
        """Put places into the index under the ranks of their pairs."""
        ranks = rank[places]
        order = np.argsort(ranks, kind="stable")
        order = order[:np.searchsorted(ranks[order], _NONE)]
        if not len(order):
            return
        places, ranks = places[order], ranks[order]
        cut = np.flatnonzero(np.diff(ranks)) + 1
        for r, part in zip(ranks[np.append(0, cut)].tolist(), np.split(places, cut)):
            if r not in index:
                index[r] = []
                heapq.heappush(heap, r)
            index[r].append(part)

    add(pairs)
    while heap:
        now = heapq.heappop(heap)
        found = index.pop(now)
        at = np.unique(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])
        at = at[rank[at] == now]
        if not len(at):
            continue
        # of a run of places that overlap, such as in `aaaa`, every second one merges
        follows = np.append(False, right[at[:-1]] == at[1:])
        if follows.any():
            place = np.arange(len(at))
            begin = np.maximum.accumulate(np.where(follows, 0, place))
            at = at[(place - begin) % 2 == 0]
        gone = right[at]
        after = right[gone]
        beside = np.flatnonzero(after[:-1] == at[1:])  # for a moment, the left of two has an unmerged neighbour
        if len(beside):
            early = vocab.merged(np.int64(now), token[at[beside + 1]]) < now
            odd[owner[at[beside[early]]]] = True
        token[at] = now
        right[at] = after
        has = after >= 0
        left[after[has]] = at[has]
        alive[gone] = False
        rank[gone] = _NONE
        before = left[at]
        touched = np.unique(np.concatenate([at, before[before >= 0]]))
        other = right[touched]
        rank[touched] = np.where(other >= 0, vocab.merged(token[touched], token[other]), _NONE)
        early = rank[touched] < now
        if early.any():
            odd[owner[touched[early]]] = True
        add(touched)

    if odd.any():
        alive &= ~odd[owner]
    kept = np.flatnonzero(alive)
    count = np.bincount(owner[kept], minlength=len(words))
    ids = token[kept]
    single = np.flatnonzero(whole >= 0)
    alone = {int(i): one_by_one(words[i], vocab) for i in np.flatnonzero(odd)}
    count[single] = 1
    for i, own in alone.items():
        count[i] = len(own)
    out = np.empty(count.sum(), np.uint32)
    begin = np.cumsum(count) - count
    out[begin[single]] = whole[single]
    rest = np.flatnonzero((whole < 0) & ~odd)
    n_rest = count[rest]
    out[np.arange(n_rest.sum()) - np.repeat(np.cumsum(n_rest) - n_rest, n_rest) + np.repeat(begin[rest], n_rest)] = ids
    for i, own in alone.items():
        out[begin[i]:begin[i] + len(own)] = own
    return out, count


class Numbers(dict):
    """Words numbered in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Block:
    """The distinct words that a task has met, and their ids once they are replayed."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.number = Numbers()
        self.bytes = self.known = 0
        self.ids, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def numbers(self, words: list[str]) -> np.ndarray:
        before = len(self.number)
        out = np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))
        self.bytes += sum(map(len, islice(reversed(self.number), len(self.number) - before)))
        return out

    def learn(self) -> None:
        """Replay the words that are new."""
        new = [w.encode() for w in islice(reversed(self.number), len(self.number) - self.known)][::-1]
        if new:
            ids, count = replay(new, self.vocab)
            self.ids, self.count = np.concatenate([self.ids, ids]), np.concatenate([self.count, count])
            self.begin = np.cumsum(self.count) - self.count
            self.known += len(new)

    def encode(self, numbers: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, len(numbers), STEP):
            part = numbers[at:at + STEP]
            count = self.count[part]
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(
                self.begin[part], count)
            out.append(self.ids[place])
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def encode_texts(texts, vocab: Vocabulary, pattern: str, word_bytes: int = WORD_BYTES):
    """Yield the ids of every text, in order. Texts wait until a block of distinct words is full."""
    import regex

    split = regex.compile(pattern)
    block, waiting, held = Block(vocab), [], 0  # a text's parts are numbers of words, or ids already

    def settled(parts: list[np.ndarray]) -> list[np.ndarray]:
        return [p if p.dtype == np.uint32 else block.encode(p) for p in parts]

    def flush(texts: list[list[np.ndarray]]):
        block.learn()
        for parts in texts:
            yield np.concatenate([np.zeros(0, np.uint32), *settled(parts)])

    for text in texts:
        parts: list[np.ndarray] = []
        waiting.append(parts)
        for words in _runs(split, text or ""):
            parts.append(block.numbers(words))
            held += len(words)
            if block.bytes >= word_bytes:  # texts before this one are done; it may go on
                yield from flush(waiting[:-1])
                parts[:] = settled(parts)
                waiting, held = [parts], 0
                block.clear()
        if held >= STEP:
            yield from flush(waiting)
            waiting, held = [], 0
    yield from flush(waiting)


def _runs(split, text: str):
    """The words of a text, in lists of bounded length."""
    if len(text) <= STEP:
        yield split.findall(text)
        return
    found = (m[0] for m in split.finditer(text))
    while run := list(islice(found, STEP)):
        yield run


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           word_bytes: int = WORD_BYTES) -> DataFrame:
    """`doc_id`, `ids` (array of integers) of every row."""
    def run(batches):
        vocab, waiting = vocabulary(path), []

        def texts():
            for batch in batches:
                column = batch.column("text")
                for at in range(0, batch.num_rows, 256):
                    part = column.slice(at, 256).to_pylist()
                    waiting.append([batch.column("id").slice(at, 256), len(part)])
                    yield from part

        def rows(ids, n):
            offsets = np.append(0, np.cumsum([len(i) for i in ids]))
            flat = pa.array(np.concatenate(ids).view(np.int32), pa.int32())
            return pa.RecordBatch.from_arrays(
                [n, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat)], ["doc_id", "ids"])

        out = []
        for ids in encode_texts(texts(), vocab, pattern, word_bytes):
            out.append(ids)
            if len(out) == waiting[0][1]:
                yield rows(out, waiting.pop(0)[0])
                out = []

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """`doc_id`, `ids` and the bytes that they stand for, `decoded`."""
    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column("ids")
                offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype(np.int64)
                texts = [vocab.decode(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())],
                                                 ["doc_id", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def query(spark, folder) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = encode(read(spark, folder, "documents"), path, public_tokenizers.PATTERN)
    return decode(encoded, path).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
