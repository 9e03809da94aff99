"""Keys that earlier runs have stored, and joins that leave them where they lie.

Keys are kept in a bucketed table, sorted inside the files, so a join against them
moves only what comes in: the distinct incoming keys go to the buckets, the stored
side is read in place, without an exchange. In front of it stands a Bloom filter in blocks
of 256 bits, a row each in a bucketed table of its own: a key belongs to one block
and sets a bit in each of its four words. Keys whose bits aren't all set
are new for certain and never meet the stored ones. The others do, so results are
exact whatever the filter says.

Files are added by runs and never changed; a key that is added twice counts once,
so a run that is repeated does no harm. Null keys are kept and found like others.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files

WORDS = ["w0", "w1", "w2", "w3"]
_BLOCK = T.StructType([T.StructField("block", T.LongType()), *[T.StructField(w, T.LongType()) for w in WORDS]])


class History:
    """The keys (`keys`: names and types) stored below `path`.

    `buckets` is fixed when a history is made: choose it so that a bucket of the
    expected keys fits a task; `blocks` of 256 bits: about one for every 20
    expected keys.
    """

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str], buckets: int = 64, blocks: int = 1 << 16):
        self.spark, self.path = spark, path.rstrip("/")
        made = {"keys": keys, "buckets": buckets, "blocks": blocks}
        files.create(spark, f"{self.path}/_history.json", json.dumps(made))
        made = json.loads(files.read_text(spark, f"{self.path}/_history.json"))
        if made["keys"] != keys:
            raise ValueError(f"{path} holds other keys: {made['keys']}")
        self.keys, self.buckets, self.blocks = list(keys), made["buckets"], made["blocks"]
        # equality of joins is null-safe on text forms, which buckets can be made of
        self.stored = [f"k_{k}" for k in self.keys]
        columns = ", ".join(f"{k} STRING" for k in self.stored)
        self.table = self._bucketed("keys", columns, self.stored)
        self.filter = self._bucketed("filter", ", ".join(f"{f.name} BIGINT" for f in _BLOCK), ["block"])

    def _bucketed(self, name: str, columns: str, by: list[str]) -> str:
        """Make the files at a place known to this session as a bucketed table."""
        table = f"history_{name}_" + hashlib.sha256(self.path.encode()).hexdigest()[:24]
        by = ", ".join(by)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) "
            f"INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return table

    def _key(self, name: str) -> Column:
        """A key as text; nulls are told apart from texts."""
        return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))

    def _hash(self) -> Column:
        return F.xxhash64(*self.stored)

    def _block(self) -> Column:
        return F.pmod(F.col("_hash"), F.lit(self.blocks)).cast("bigint")

    def _bit(self, word: int) -> Column:
        """The bit of a key in a word of its block; bits of the hash above those that choose the block."""
        place = F.shiftrightunsigned("_hash", 34 + 6 * word).bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)

    def _keyed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({s: self._key(k) for s, k in zip(self.stored, self.keys)}).withColumn("_hash", self._hash())

    def add(self, rows: DataFrame) -> None:
        """Store the keys of rows, and their bits."""
        keys = self._keyed(rows.select(*self.keys)).select(*self.stored).distinct()
        keys.repartition(self.buckets, *self.stored).write.insertInto(self.table)
        hashed = keys.withColumn("_hash", self._hash())
        bits = hashed.groupBy(self._block().alias("block")).agg(
            *[F.bit_or(self._bit(i)).alias(w) for i, w in enumerate(WORDS)])
        bits.repartition(self.buckets, "block").write.insertInto(self.filter)
        self.spark.catalog.refreshTable(self.table)
        self.spark.catalog.refreshTable(self.filter)

    def _sifted(self, incoming: DataFrame) -> DataFrame:
        """The distinct keys of incoming rows, and `_maybe`: whether the filter allows that they are stored."""
        blocks = self.spark.table(self.filter).groupBy("block").agg(*[F.bit_or(w).alias(f"_{w}") for w in WORDS])
        keys = self._keyed(incoming.select(*self.keys)).select(*self.stored).distinct()
        hashed = keys.withColumn("_hash", self._hash()).withColumn("block", self._block())
        joined = hashed.join(blocks, "block", "left")
        maybe = F.lit(True)
        for i, w in enumerate(WORDS):
            maybe = maybe & (F.col(f"_{w}").bitwiseAND(self._bit(i)) != 0)
        return joined.select(*self.stored, F.coalesce(maybe, F.lit(False)).alias("_maybe"))

    def _rows_of(self, incoming: DataFrame, keys: DataFrame) -> DataFrame:
        """The incoming rows of some keys; repeats of a key stay."""
        marked = {s: f"_{i}_{s}" for i, s in enumerate(self.stored)}
        rows = incoming.withColumns({marked[s]: self._key(k) for s, k in zip(self.stored, self.keys)})
        keys = keys.select(*[F.col(s).alias(m) for s, m in marked.items()])
        return rows.join(keys, list(marked.values()), "left_semi").select(*incoming.columns)

    def new(self, incoming: DataFrame) -> DataFrame:
        """The incoming rows, repeats included, whose keys aren't stored."""
        sifted = self._sifted(incoming)
        certain = sifted.where(~F.col("_maybe")).select(*self.stored)
        checked = sifted.where("_maybe").select(*self.stored).join(
            self.spark.table(self.table), self.stored, "left_anti")
        return self._rows_of(incoming, certain.unionByName(checked))

    def known(self, incoming: DataFrame) -> DataFrame:
        """The incoming rows whose keys are stored."""
        checked = self._sifted(incoming).where("_maybe").select(*self.stored).join(
            self.spark.table(self.table), self.stored, "left_semi")
        return self._rows_of(incoming, checked)
