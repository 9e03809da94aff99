"""Packing by concatenating and cutting.

One pass encodes the documents in the order in which they are read and stores
their ids with the place in their partition; the totals of the partitions are
summed up to global offsets; a second pass cuts every document at the edges of
fixed windows. All sequences but the last are full. No text and no ids are
shuffled, and a long document is only a row with many pieces.

Defined results: a null or empty text is its end id alone; repeated rows and rows
without an id are packed like any others; extra columns are ignored; an empty
table gives no pieces.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read, saved
from .encoding import encoder, row_runs

LENGTH = 1024


def encode_in_place(docs: DataFrame, path: str, style: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Stored rows: partition, ids before the document there, id, ids (unsigned 32-bit)."""
    def run(batches):
        from pyspark import TaskContext

        words, number, before = encoder(path, style), TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for at, n in row_runs(batch.column("text")):
                part = batch.slice(at, n)
                ids = [np.concatenate([i, end]) for i in words.encode(part.column("text"))]
                sizes = np.array([len(i) for i in ids], np.int64)
                starts = before + np.cumsum(sizes) - sizes
                before += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), number, np.int32)), pa.array(starts), part.column("id"),
                     pa.array(sizes), pa.array([i.tobytes() for i in ids], pa.binary())],
                    ["partition", "before", "doc_id", "doc_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return saved(rows.mapInArrow(run, f"partition int, before bigint, doc_id {kind}, doc_tokens bigint, ids binary"),
                 "encoded")


def pack(docs: DataFrame, path: str, style: str = "spaced", end_id: int = 0, length: int = LENGTH,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: `doc_id`, `start`, `length`, `ids`, `doc_tokens`, `sequence_id`, `offset`."""
    encoded = encode_in_place(docs, path, style, end_id, id_col, text_col)
    before = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    totals = encoded.groupBy("partition").agg(F.sum("doc_tokens").alias("total"))
    bases = saved(totals.select("partition", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "bases")
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            at, sizes = batch.column("at").to_numpy(), batch.column("doc_tokens").to_numpy()
            first, last = at // length, (at + sizes - 1) // length
            count = last - first + 1
            doc = np.repeat(np.arange(len(at)), count)
            sequence = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[doc]
            begin = np.maximum(sequence * length, at[doc])
            stop = np.minimum((sequence + 1) * length, (at + sizes)[doc])
            ids, start, n = batch.column("ids").to_pylist(), begin - at[doc], stop - begin
            pieces = [ids[d][4 * a:4 * (a + b)] for d, a, b in zip(doc, start, n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(n),
                 pa.array(pieces, pa.binary()), pa.array(sizes[doc]), pa.array(sequence), pa.array(begin % length)],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    placed = encoded.join(bases, "partition").select(  # one row a partition: adaptive execution checks its size
        (F.col("base") + F.col("before")).alias("at"), "doc_id", "doc_tokens", "ids")
    return placed.mapInArrow(cut, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, "
                                   "sequence_id bigint, offset bigint")


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """Padded sequences with boundary records: where in them which part of a document lies.

    The last sequence is padded to `length` unless its size is a power of two.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids")))
    whole = pieces.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("n_tokens"))
    power = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    size = F.when(power, F.col("n_tokens")).otherwise(length)
    pad = F.to_binary(F.lit(int(pad_id).to_bytes(4, "little").hex()), F.lit("hex"))
    ids = F.aggregate("parts", F.lit(b"").cast("binary"), lambda out, p: F.concat(out, p["ids"]))
    filling = F.aggregate(F.array_repeat(pad, (size - F.col("n_tokens")).cast("int")), F.lit(b"").cast("binary"),
                          lambda out, p: F.concat(out, p))
    return whole.select("sequence_id", "n_tokens", F.concat(ids, filling).alias("ids"),
                        F.transform("parts", lambda p: p.dropFields("ids")).alias("boundaries"))


def with_checksums(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def query(spark, folder) -> DataFrame:
    import public_tokenizers

    return with_checksums(pack(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
