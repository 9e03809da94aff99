"""Token-id files of compressed byte or bit planes.

Texts are range-partitioned by document id and encoded in that order. A file
holds fixed-size blocks of unsigned 32-bit ids; a block is transposed into planes
(the first bytes, or bits, of all its ids, then the second, and so on), each
compressed with zstandard, and an index of chunks and documents closes the file.
Tasks write files under fresh names into the shared folder and return manifest
rows; only files whose rows Spark committed count, so retried tasks do no harm.
Starts over all files are prefix sums of the files' totals.

Defined results: a null or empty text has only its end id; rows without an id
come first; rows that share an id are ordered by a hash of their text, and
repeated rows are all written; extra columns are ignored; an empty table gives no
files and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_run_dir
from .common import arrow, open_folder, read, saved
from .encoding import encoder, row_runs

#: Ids of a block; ids after which a file is closed.
BLOCK_IDS, FILE_IDS = 1 << 16, 1 << 26
#: Fixed value: the mark at both ends of a file.
MAGIC = b"IDPLANE1"

_MANIFEST = "partition int, file int, path string, n_ids bigint, n_docs bigint"
_READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The 4 byte planes or 32 bit planes of unsigned 32-bit ids, lowest first."""
    split = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        split = np.unpackbits(split, axis=1, bitorder="little")
        return [np.packbits(plane, bitorder="little").tobytes() for plane in np.ascontiguousarray(split.T)]
    return [plane.tobytes() for plane in np.ascontiguousarray(split.T)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    rows = [np.frombuffer(p, np.uint8) for p in planes]
    if bits:
        flat = np.stack([np.unpackbits(r, count=n, bitorder="little") for r in rows], 1)
        return np.packbits(flat, axis=1, bitorder="little").reshape(-1).view("<u4")
    return np.ascontiguousarray(np.stack(rows, 1)).reshape(-1).view("<u4")


class Writer:
    """One file: blocks as they fill, then the index."""

    def __init__(self, stream, bits: bool):
        self.stream, self.bits, self.at = stream, bits, 0
        self.compressor = zstandard.ZstdCompressor(level=3)
        self.waiting, self.n_waiting = [], 0
        self.chunks, self.docs, self.sizes, self.n_ids = [], [], [], 0
        self._put(MAGIC + bytes([32 if bits else 4]))

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def _block(self, ids: np.ndarray) -> None:
        packed = [self.compressor.compress(p) for p in to_planes(ids, self.bits)]
        self.chunks.append([self.at, len(ids), *map(len, packed)])
        self._put(b"".join(packed))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids))
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK_IDS:
            joined = np.concatenate(self.waiting)
            full = len(joined) // BLOCK_IDS * BLOCK_IDS
            for i in range(0, full, BLOCK_IDS):
                self._block(joined[i:i + BLOCK_IDS])
            self.waiting, self.n_waiting = [joined[full:]], len(joined) - full

    def close(self) -> None:
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        index_at = self.at
        known = np.array([d is not None for d in self.docs], np.uint8)
        parts = [np.array(self.chunks, "<i8").tobytes(), np.array([d or 0 for d in self.docs], "<i8").tobytes(),
                 known.tobytes(), np.array(self.sizes, "<i8").tobytes()]
        packed = self.compressor.compress(b"".join(parts))
        self._put(packed)
        self._put(struct.pack("<qqqq", index_at, len(packed), len(self.chunks), len(self.docs)) + MAGIC)
        self.stream.close()


def read_file(source):
    """Yield (doc_id, size, ids in parts) of a file, a block in memory at a time."""
    size = source.size()
    source.seek(size - 40)
    index_at, packed, n_chunks, n_docs = struct.unpack("<qqqq", source.read(32))
    if source.read(8) != MAGIC:
        raise ValueError("not a token file")
    source.seek(8)
    planes = source.read(1)[0]
    unpack = zstandard.ZstdDecompressor()
    source.seek(index_at)
    index = unpack.decompress(source.read(packed))
    chunks = np.frombuffer(index, "<i8", n_chunks * (2 + planes)).reshape(n_chunks, 2 + planes)
    rest = index[chunks.nbytes:]
    docs = np.frombuffer(rest, "<i8", n_docs)
    known = np.frombuffer(rest, np.uint8, n_docs, 8 * n_docs)
    sizes = np.frombuffer(rest, "<i8", n_docs, 9 * n_docs)

    def blocks():
        for at, n, *lengths in chunks.tolist():
            source.seek(at)
            data, place, parts = source.read(sum(lengths)), 0, []
            for length in lengths:
                parts.append(unpack.decompress(data[place:place + length]))
                place += length
            yield from_planes(parts, n, planes == 32)

    stream, block, used = blocks(), np.zeros(0, "<u4"), 0
    for doc, there, n in zip(docs.tolist(), known.tolist(), sizes.tolist()):
        parts, left = [], n
        while left:
            if used == len(block):
                block, used = next(stream), 0
            take = min(left, len(block) - used)
            parts.append(block[used:used + take])
            used, left = used + take, left - take
        yield doc if there else None, n, parts


def write_tokens(docs: DataFrame, path: str, style: str, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text", bits: bool = False) -> DataFrame:
    """Write the files; a manifest row for each, with its place in document order and its totals."""
    folder = new_run_dir(docs.sparkSession, "tokens")

    def run(batches):
        from pyspark import TaskContext

        words, number = encoder(path, style), TaskContext.get().partitionId()
        files, place = open_folder(folder)
        files.create_dir(place, recursive=True)
        end, writer, name, count = np.array([end_id], np.uint32), None, "", 0

        def closed():
            writer.close()
            return arrow([{"partition": number, "file": count, "path": name, "n_ids": writer.n_ids,
                           "n_docs": len(writer.docs)}], _MANIFEST)

        for batch in batches:
            keys = batch.column("id").to_pylist()
            for at, n in row_runs(batch.column("text")):
                for key, ids in zip(keys[at:at + n], words.encode(batch.column("text").slice(at, n))):
                    if writer is None:
                        name = f"{number:06d}-{count:04d}-{uuid.uuid4().hex}.idp"
                        writer = Writer(files.open_output_stream(f"{place}/{name}"), bits)
                    writer.add(key, np.concatenate([ids, end]))
                    if writer.n_ids >= FILE_IDS:
                        yield closed()
                        writer, count = None, count + 1
        if writer is not None:
            yield closed()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    spread = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    manifest = saved(spread.mapInArrow(run, _MANIFEST), "manifest")
    before = Window.orderBy("partition", "file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).withColumn(
        "path", F.concat(F.lit(folder + "/"), "path"))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: id, start over all files, ids, and their checksum."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                files, place = open_folder(row["path"])
                at, out = row["start"], []
                with files.open_input_file(place) as source:
                    for doc, n, parts in read_file(source):
                        crc = 0
                        for part in parts:
                            crc = zlib.crc32(part.tobytes(), crc)
                        out.append({"doc_id": doc, "start": at, "n_tokens": n, "ids_crc32": crc})
                        at += n
                        if len(out) == 10_000:
                            yield arrow(out, _READ)
                            out = []
                yield arrow(out, _READ)

    files = max(1, manifest.count())
    return manifest.select("path", "start").repartition(files).mapInArrow(run, _READ)


def query(spark, folder) -> DataFrame:
    import public_tokenizers

    manifest = write_tokens(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"),
                            "dropped", end_id=2)
    return read_tokens(manifest)
