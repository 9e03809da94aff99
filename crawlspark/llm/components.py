"""Connected components by alternating large and small stars, in stored tables.

Every round is aggregations and joins over edges; no component is brought together in
one task. Edges are first contracted inside their partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

_PAIR = "u bigint, v bigint"


#: Edges that a task contracts at once.
CONTRACTED = 1 << 20


def _stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Each node of the edges with the smallest node that it reaches over them."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[:len(a)], ends[len(a):]
    root = np.arange(len(nodes))
    while True:  # smaller roots spread over the edges, then along themselves
        low = np.minimum(root[a], root[b])
        before = root.copy()
        for at in (root[a], root[b], a, b):
            np.minimum.at(root, at, low)
        root = root[root]
        if (root == before).all():
            break
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], ["u", "v"])


def contract(edges: DataFrame) -> DataFrame:
    """The edges of a partition, or of parts of a large one, as stars."""
    def run(batches):
        kept, size = [], 0
        for batch in batches:
            kept.append(batch)
            size += batch.num_rows
            if size >= CONTRACTED:
                yield _joined(kept)
                kept, size = [], 0
        if size:
            yield _joined(kept)

    return edges.mapInArrow(run, _PAIR)


def _joined(batches: list) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    return _stars(table.column(0).to_numpy(), table.column(1).to_numpy())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """`node`, `component` (its smallest node) of all nodes that aren't the smallest. `edges`: two bigint columns."""
    pairs = edges.toDF("u", "v").filter("u <> v")
    stars = saved(contract(pairs).distinct(), name)
    size = None
    while True:
        both = stars.union(stars.select("v", "u"))
        least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), name)
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(large.filter("u <> v").distinct(), name)
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = saved(small.union(least.select("u", F.col("m").alias("v"))).distinct(), name)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == size:
            return stars.toDF("node", "component")
        size = now
