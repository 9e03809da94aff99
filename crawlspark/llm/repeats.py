"""Removal of long byte strings that occur more than once, by bucket-pointer refinement.

Every `LENGTH`-byte string is represented by its anchor, the least of its q-grams
by hash; equal strings have the same anchor at the same place, so only strings
with an anchor in common have to be compared. Runs of strings with one anchor are
grouped by their bytes: runs found twice are repeated throughout. What is left of
anchors with differing runs is cut out of the texts, range-partitioned by anchor,
and sorted block by block with a suffix sort: initial buckets of q-grams, a
quarter of `LENGTH` long, are refined by the bucket pointers at later offsets,
doubling the depth up to `LENGTH` bytes, each round reusing the buckets that the
one before has split and sorting only those that still hold several suffixes. Strings in a bucket with
others are repeated. An anchor on the edge of a block may go on in the next; its
strings are counted by hash over all blocks, sixteen and then four neighbours at
a time before one by one, so a frequent passage is spread over many tasks and
nothing is cut off.

Defined results: a null text is empty; shorter texts have no such string; matches
never cross documents; repeated rows are documents of their own, so their strings
repeat; a text of any length is worked on in segments; extra columns are ignored
or kept; an empty table gives no rows. Strings count as equal when the 64-bit
hashes of their anchors and those of their bytes or q-grams agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, prefix_hash, read, saved, span_hash, text_slices

LENGTH = 400
#: Bytes of an anchor; bytes of a block that is sorted at once; windows of a segment of a text.
GRAM, BLOCK_BYTES, SEGMENT = 32, 1 << 21, 1 << 20

_RUNS = "k1 bigint, k2 bigint, first bigint, last bigint, place bigint, anchor bigint, run bigint"
_FOUND = ("k1 bigint, k2 bigint, start bigint, stop bigint, anchor bigint, core bigint, "
          "parts array<struct<core:bigint,strings:array<struct<start:bigint,string:bigint,done:boolean>>>>")
_STRING = pa.struct([("start", pa.int64()), ("string", pa.int64()), ("done", pa.bool_())])
_PART = pa.struct([("core", pa.int64()), ("strings", pa.list_(_STRING))])


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of every window, by minima from the edges of blocks of `width`."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(keys)] = keys
    blocks = padded.reshape(-1, width)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    before = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    return np.minimum(after[:n], before[width - 1:width - 1 + n])


def anchor_runs(data: np.ndarray, length: int = LENGTH):
    """(first window, last window, place, anchor, hash of the run) of each anchor of a text, as columns."""
    out = []
    gram = min(GRAM, length)
    for begin in range(0, len(data) - length + 1, SEGMENT):
        part = data[begin:begin + SEGMENT + length - 1]
        sums = prefix_hash(part)
        at = np.arange(len(part) - gram + 1)
        grams = span_hash(sums, at, at + gram)
        keys = (grams >> np.uint64(24) << np.uint64(24)) | at.astype(np.uint64)  # ties go to the left
        place = (sliding_least(keys, length - gram + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], len(place)) - 1
        place = place[first]
        run = span_hash(sums, first, last + length)
        shape = (place - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64)
        out.append((first + begin, last + begin, place + begin, grams[place].view(np.int64),
                    mix(run + mix(shape)).view(np.int64)))
    return [np.concatenate(c) for c in zip(*out)] if out else None


def _key(id_col: str, text_col: str) -> list:
    """Bytes of a text, and a key of text and id; rows that repeat both share it."""
    text = F.col(text_col)
    return [F.xxhash64(F.coalesce(text, F.lit(""))).alias("k1"),
            F.coalesce(F.xxhash64(F.col(id_col)), F.lit(0)).alias("k2"),
            F.coalesce(F.encode(text, "UTF-8"), F.lit(b"")).alias("data")]


def runs_of(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            parts = []
            for row, data, starts, ends in text_slices(batch.column("data")):
                for i in np.flatnonzero(ends - starts >= length):
                    found = anchor_runs(data[starts[i]:ends[i]], length)
                    n = len(found[0])
                    parts.append([np.full(n, k1[row + i]), np.full(n, k2[row + i]), *found])
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*parts)], [f.split()[0] for f in _RUNS.split(", ")])

    return saved(docs.mapInArrow(run, _RUNS), "runs")


def refined_buckets(data: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """A bucket number for every position with `length` bytes before its end: equal for equal strings.

    `ends`: where the piece of each position ends. Other positions get numbers
    that mean nothing.
    """
    at = np.arange(len(data))
    depth = -(-length // 4)
    fits = np.flatnonzero(at + depth <= ends)
    bucket, crowd = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
    _, number, count = np.unique(span_hash(prefix_hash(data), fits, fits + depth),
                                 return_inverse=True, return_counts=True)
    bucket[fits], crowd[fits], top = number + 1, count[number], len(count) + 1
    while depth < length:
        step = min(depth, length - depth)
        open_ = np.flatnonzero((crowd > 1) & (at + depth + step <= ends))  # the others are settled
        # the bucket pointer `step` later orders the suffixes of a bucket further
        _, number, count = np.unique(bucket[open_] * top + bucket[open_ + step],
                                     return_inverse=True, return_counts=True)
        bucket[open_], crowd[open_] = number + top, count[number]
        top += len(count)
        depth += step
    return bucket


def compare_block(rows: dict[str, list], length: int) -> pa.RecordBatch:
    """Repeated strings of a block as spans; the strings of its first and last anchor with their hashes."""
    pieces = rows["piece"]
    sizes = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.repeat(np.cumsum(sizes), sizes)
    piece = np.repeat(np.arange(len(sizes)), sizes)
    begins = np.cumsum(sizes) - sizes
    window = np.flatnonzero(np.arange(len(data)) + length <= ends)
    bucket = refined_buckets(data, ends, length)[window]
    owner = piece[window]
    _, inverse, first, count = _unique(bucket)
    twice = count[inverse] > 1
    anchor = np.array(rows["anchor"], np.int64)
    single = np.array(rows["single"], bool)
    k1, k2 = np.array(rows["k1"], np.int64), np.array(rows["k2"], np.int64)
    start = window - begins[owner] + np.array(rows["first"], np.int64)[owner]
    # spans of consecutive repeated strings, of pieces that aren't repeated as a whole
    hit = np.flatnonzero(twice & single[owner])
    edge = np.flatnonzero(np.diff(owner[hit], prepend=-1).astype(bool) | (np.diff(start[hit], prepend=-2) != 1))
    stop = np.append(edge[1:], len(hit)) - 1
    spans = [k1[owner[hit[edge]]], k2[owner[hit[edge]]], start[hit[edge]], start[hit[stop]] + length] if len(hit) else [
        np.zeros(0, np.int64)] * 4
    # strings that may go on beyond the block: each once, in packed rows
    open_ = np.zeros(len(window), bool)
    open_[first] = True
    open_ = np.flatnonzero((open_ | ~twice) & ((anchor[owner] == anchor[0]) | (anchor[owner] == anchor[-1])))
    place = np.array(rows["place"], np.int64)
    back = place[owner[open_]] - start[open_]  # how far before its anchor a string begins
    order = np.lexsort((back, owner[open_]))
    open_, back = open_[order], back[order]
    mine = owner[open_]
    sums = prefix_hash(data)
    string = span_hash(sums, window[open_], window[open_] + length).view(np.int64)
    flat = pa.StructArray.from_arrays(
        [pa.array(start[open_]), pa.array(string), pa.array(twice[open_] | ~single[mine])], fields=list(_STRING))

    def cores(width, at):
        """Hashes of the bytes that all strings of a group have in common."""
        begin = begins[mine[at]] + place[mine[at]] - back[at] // width * width - np.array(rows["first"], np.int64)[mine[at]]
        return span_hash(sums, begin, begin + length - width + 1).view(np.int64)

    large, little = group_widths(length)
    part = np.flatnonzero(np.diff(mine, prepend=-1).astype(bool) | np.diff(back // little, prepend=-1).astype(bool))
    parts = pa.StructArray.from_arrays(
        [pa.array(cores(little, part)),
         pa.ListArray.from_arrays(pa.array(np.append(part, len(mine)).astype(np.int32)), flat)], fields=list(_PART))
    row = np.flatnonzero(np.diff(mine[part], prepend=-1).astype(bool) |
                         np.diff(back[part] // large, prepend=-1).astype(bool))
    packed = pa.ListArray.from_arrays(pa.array(np.append(row, len(part)).astype(np.int32)), parts)
    row = part[row]
    none = len(spans[0])
    columns = [pa.array(np.concatenate(c)) for c in zip(spans, (
        k1[mine[row]], k2[mine[row]], start[open_[row]], start[open_[row]] + length))]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array(np.concatenate([np.zeros(none, np.int64), anchor[mine[row]]])),
         pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(cores(large, row))]),
         pa.concat_arrays([pa.nulls(none, packed.type), packed])], [f.name for f in _SCHEMA])


_SCHEMA = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()),
                     ("anchor", pa.int64()), ("core", pa.int64()), ("parts", pa.list_(_PART))])


def group_widths(length: int) -> tuple[int, int]:
    """How many neighbouring strings of an anchor are first, and then, looked at together."""
    little = max(1, min(4, length // 8))
    return min(4 * little, length), little


def _unique(values):
    kept, first, inverse, count = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
    return kept, inverse, first, count


def compared(pieces: DataFrame, length: int) -> DataFrame:
    columns = ["k1", "k2", "first", "place", "anchor", "single", "piece"]

    def run(batches):
        rows, size = {c: [] for c in columns}, 0
        for batch in batches:
            part = {c: batch.column(c).to_pylist() for c in columns}
            at = 0
            for i, piece in enumerate(part["piece"]):
                size += len(piece)
                if size >= BLOCK_BYTES:
                    for c in columns:
                        rows[c] += part[c][at:i + 1]
                    yield compare_block(rows, length)
                    rows, size, at = {c: [] for c in columns}, 0, i + 1
            for c in columns:
                rows[c] += part[c][at:]
        if rows["piece"]:
            yield compare_block(rows, length)

    spread = pieces.select(*columns, "run").repartitionByRange("anchor", "run", "k1", "k2", "first")
    return saved(spread.sortWithinPartitions("anchor", "run").drop("run").mapInArrow(run, _FOUND), "compared")


def _twice(rows: DataFrame, column: str) -> DataFrame:
    """The rows whose anchor and `column` occur more than once."""
    keys = ["anchor", column]
    return rows.join(saved(rows.groupBy(*keys).count().filter("count > 1").select(*keys), "twice"), keys)


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """`k1`, `k2`, `start`, `stop`: spans of bytes in repeated strings; they may overlap."""
    runs = runs_of(docs, length)
    shared = saved(runs.groupBy("anchor").agg(
        F.count("*").alias("n"), (F.min("run") != F.max("run")).alias("mixed")).filter("n > 1").select(
        "anchor", "mixed"), "anchors")
    common = saved(runs.join(shared, "anchor"), "common")
    mark = F.xxhash64("k1", "k2", "first")
    sizes = saved(common.groupBy("anchor", "run").agg(F.count("*").alias("n"), F.min(mark).alias("mark")), "sizes")
    known = saved(common.join(sizes, ["anchor", "run"]).select(
        "k1", "k2", "first", "last", "place", "anchor", "run", "mixed", (F.col("n") == 1).alias("single"),
        (mark == F.col("mark")).alias("one")), "known")
    # rows that repeat share their keys: one set of runs and pieces stands for them all
    whole = known.filter(~F.col("single")).select("k1", "k2", F.col("first").alias("start"),
                                                  (F.col("last") + length).alias("stop")).distinct()
    piece = F.substring("data", F.col("first").cast("int") + 1, (F.col("last") - F.col("first") + length).cast("int"))
    part = known.filter("mixed AND one").drop("mixed", "one").distinct().join(docs, ["k1", "k2"]).select(
        "k1", "k2", "first", "place", "anchor", "run", "single", piece.alias("piece")).dropDuplicates(
        ["k1", "k2", "first"])
    found = compared(part, length)
    # what strings of a group have in common has to occur twice before they are looked at one by one
    groups = _twice(found.filter("core IS NOT NULL").select("k1", "k2", "anchor", "core", "parts"), "core")
    parts = groups.select("k1", "k2", "anchor", F.explode("parts").alias("p")).select("k1", "k2", "anchor", "p.*")
    strings = _twice(saved(parts, "parts"), "core").select(
        "k1", "k2", "anchor", F.explode("strings").alias("s")).select("k1", "k2", "anchor", "s.*")
    beyond = _twice(saved(strings, "strings"), "string").filter("NOT done").select(
        "k1", "k2", "start", (F.col("start") + length).alias("stop"))
    inside = found.filter("core IS NULL").select("k1", "k2", "start", "stop")
    return whole.union(inside).union(beyond)


def _union(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: `doc_id`, `n_bytes`, `n_removed`, `kept` (the other bytes), `removed` (maximal spans)."""
    spans = repeated_spans(docs.select(*_key(id_col, text_col)), length).groupBy("k1", "k2").agg(
        F.collect_list(F.struct("start", "stop")).alias("spans"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), *_key(id_col, text_col))

    def run(batches):
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                kept, removed = [], []
                for data, found in zip(part.column("data").to_pylist(), part.column("spans").to_pylist()):
                    cut, out, place = _union(found), [], 0
                    for a, b in cut:
                        out.append(data[place:a])
                        place = b
                    kept.append(b"".join([*out, data[place:]]))
                    removed.append([{"start": a, "stop": b} for a, b in cut])
                sizes = np.array([len(d) for d in part.column("data").to_pylist()], np.int64)
                left = np.array([len(k) for k in kept], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes), pa.array(sizes - left), pa.array(kept, pa.binary()),
                     pa.array(removed, span)], ["doc_id", "n_bytes", "n_removed", "kept", "removed"])

    return rows.join(spans, ["k1", "k2"], "left").select("doc_id", "data", "spans").mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, kept binary, removed array<struct<start:bigint,stop:bigint>>")


def query(spark, folder) -> DataFrame:
    return remove_repeats(read(spark, folder, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))
