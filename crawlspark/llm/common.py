"""Helpers shared by the corpus operators: stored tables, files, hashed words."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..session import new_run_dir

#: Bytes of text that a task works on at once; arrays over them take about 60 times that.
SLICE_BYTES = 1 << 20


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: lost executors don't recompute it."""
    path = new_run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow(rows: list[dict], schema: str) -> pa.RecordBatch:
    """Rows as a record batch of the types that a Spark schema string names."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
             "double": pa.float64(), "boolean": pa.bool_()}
    fields = [(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(","))]
    return pa.RecordBatch.from_pylist(rows, pa.schema(fields))


def open_folder(path: str):
    """(file system, path) of a shared folder, for tasks that write or read files in it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


# --- hashed words ----------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 4096)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if n <= 4 * SLICE_BYTES:  # a rare giant isn't kept
            _powers[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums of bytes; a span's hash is `span_hash` of them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(_INVERSE, len(sums))[starts])


def byte_class(pattern_bytes: list[tuple[int, int]], inside: bool) -> np.ndarray:
    """Table of 256: whether a byte belongs to a word. Bytes of the ranges are `inside` or not."""
    table = np.full(256, not inside)
    for low, high in pattern_bytes:
        table[low:high + 1] = inside
    return table


def hashed_words(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words in `data`, with A-Z lowered.

    `is_word` is about lowered bytes. Equal words have equal hashes; different
    ones differ but for a chance of 2**-64 a pair. Works through slices that end
    outside words.
    """
    is_word = is_word[_LOWER]
    hashes, starts = [], []
    begin = 0
    while begin < len(data):
        end = min(len(data), begin + SLICE_BYTES)
        step = 4096
        while end < len(data) and is_word[data[end - 1]]:  # go on to the end of a word
            gap = np.flatnonzero(~is_word[data[end:end + step]])
            end += int(gap[0]) + 1 if len(gap) else len(data[end:end + step])
            step *= 2
        part = data[begin:end]
        edge = np.diff(is_word[part].view(np.int8), prepend=0, append=0)
        at, to = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(at):
            hashes.append(span_hash(prefix_hash(_LOWER[part]), at, to))
            starts.append(at + begin)
        begin = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def text_slices(column: pa.ChunkedArray | pa.Array, limit: int = SLICE_BYTES):
    """Yield (first row, bytes, starts, ends) for runs of rows of about `limit` bytes.

    A newline follows every text, nulls count as empty, a longer text is a slice
    of its own.
    """
    arrays = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    first = 0
    for array in arrays:
        array = pc.fill_null(array.cast(pa.large_binary()), b"")
        sizes = pc.binary_length(array).to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(sizes + 1)])
        at = 0
        while at < len(array):
            to = max(at + 1, int(np.searchsorted(before, before[at] + limit, "right")) - 1)
            part = pc.binary_join_element_wise(array.slice(at, to - at), pa.scalar(b"\n", pa.large_binary()),
                                               pa.scalar(b"", pa.large_binary()))
            offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset:part.offset + len(part) + 1]
            data = np.frombuffer(part.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
            offsets = offsets - offsets[0]
            yield first + at, data, offsets[:-1], offsets[1:] - 1
            at = to
        first += len(array)
