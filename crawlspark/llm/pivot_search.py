"""Exact top-k search by inner product over a pivot-distance index.

Inner products become distances by one more coordinate: with M the largest norm,
x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) have |q' - x'|^2 = |q|^2 + M^2 - 2 q.x,
so the highest scores are the nearest neighbours. The index keys every vector by
its nearest pivot and the distance to it, range-partitions by this key and cuts
the sorted rows into blocks of one annulus (pivot, ring). A query finds its first
k neighbours in its own block; their score gives a radius r, and by the triangle
inequality only vectors with d(q,p) - r <= d(x,p) <= d(q,p) + r can still win.
Query blocks meet only the annuli that reach into those bounds, and in a block
only that slice of the sorted distances is scored.

Defined results: vectors that are null or empty or hold null or non-finite
components, and rows without an id, take no part; a shorter vector counts as
padded with zeros; of rows that share an id the smallest vector takes part; ties
go to the smaller id; an empty table gives no rows; extra columns are ignored.
Scores have to fit a long; where doubles can't hold them exactly, integers are
multiplied.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read, saved

#: Pivots of `BASE_VECTORS` vectors, rings of a pivot, vectors the pivots are fitted on, rows of a block, queries of a block.
PIVOTS, RINGS, SAMPLE, BLOCK, QUERIES = 16, 4, 4096, 1024, 256
#: With more vectors, pivots grow with their cube root up to a bound, and the sample with the pivots.
BASE_VECTORS, MOST_PIVOTS, SAMPLE_OF_PIVOT = 50_000, 256, 32


def pivot_count(n_vectors: int) -> int:
    """More vectors lie in more annuli, so that each is met by fewer queries and work spreads over more tasks."""
    return min(MOST_PIVOTS, round(PIVOTS * max(1.0, n_vectors / BASE_VECTORS) ** (1 / 3)))

_BLOCK = ("pivot int, ring int, ids binary, vectors binary, distances binary")
_QUERY = "pivot int, ring int, query_ids binary, query_vectors binary, floors binary"


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id and floor(scale * component) of the vectors that take part, once for each id."""
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(F.col(id_col).isNotNull() & (F.size(vector) > 0) & finite).select(
        F.col(id_col).cast("bigint").alias("id"),
        F.transform(vector, lambda x: F.floor(scale * x.cast("double"))).alias("vector")).groupBy("id").agg(
        F.min("vector").alias("vector"))


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of a list column as an integer matrix of `dim` columns, short rows padded."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim)[None, :] < sizes[:, None]] = flat
    return out


class Space:
    """Dimension, largest norm, pivots and ring edges: what every task has to know. Its size is bounded."""

    def __init__(self, dim: int, top: float, sample: np.ndarray, n_pivots: int = PIVOTS):
        self.dim, self.top = dim, top
        points = self.lift(sample)
        rng = np.random.default_rng(7)
        pivots = points[rng.choice(len(points), min(n_pivots, len(points)), replace=False)]
        for _ in range(8):
            nearest = self._distances(points, pivots).argmin(1)
            pivots = np.stack([points[nearest == i].mean(0) if (nearest == i).any() else pivots[i]
                               for i in range(len(pivots))])
        self.pivots = pivots
        reach = self._distances(points, pivots)
        nearest = reach.argmin(1)
        self.edges = np.stack([
            np.quantile(reach[nearest == i, i], np.arange(1, RINGS) / RINGS) if (nearest == i).any()
            else np.zeros(RINGS - 1) for i in range(len(pivots))])
        #: Rounding of a distance: bounds are widened by it.
        self.slack = 1e-6 * (1 + top)

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        v = vectors.astype(np.float64)
        rest = np.maximum(self.top ** 2 - (v * v).sum(1), 0)
        return np.concatenate([v, np.sqrt(rest)[:, None]], 1)

    def flat(self, vectors: np.ndarray) -> np.ndarray:
        return np.concatenate([vectors.astype(np.float64), np.zeros((len(vectors), 1))], 1)

    @staticmethod
    def _distances(a, b):
        return np.sqrt(np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0))

    def to_pivots(self, points: np.ndarray) -> np.ndarray:
        return self._distances(points, self.pivots)

    def radius(self, vectors: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """Distance beyond which a score is below the floor."""
        v = vectors.astype(np.float64)
        return np.sqrt(np.maximum((v * v).sum(1) + self.top ** 2 - 2 * floors, 0)) + self.slack

    def scores(self, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        if self.top ** 2 < 2 ** 52:
            return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
        return queries @ vectors.T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= floor)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def fit_space(vectors: DataFrame) -> Space | None:
    """Pivots from a bounded sample: the vectors first by a hash of their ids, 32 a pivot and `SAMPLE` at least."""
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    dim, top, n_vectors = vectors.agg(F.max(F.size("vector")), F.max(square), F.count("*")).first()
    if dim is None:
        return None
    n_pivots = pivot_count(n_vectors)
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(max(SAMPLE, SAMPLE_OF_PIVOT * n_pivots)).collect()
    sample = np.zeros((len(rows), dim), np.int64)
    for i, row in enumerate(rows):
        sample[i, :len(row["vector"])] = row["vector"]
    return Space(dim, float(np.sqrt(top)), sample, n_pivots)


def build_index(vectors: DataFrame, space: Space) -> DataFrame:
    """Blocks of at most `BLOCK` vectors of one annulus, sorted by distance, in the shared folder."""
    known = vectors.sparkSession.sparkContext.broadcast(space)

    def key(batches):
        space = known.value
        for batch in batches:
            matrix = _matrix(batch.column("vector"), space.dim)
            reach = space.to_pivots(space.lift(matrix))
            pivot = reach.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pivot, pa.int32()), pa.array(reach[np.arange(len(pivot)), pivot]), batch.column("id"),
                 pa.array([m.tobytes() for m in matrix], pa.binary())], ["pivot", "distance", "id", "vector"])

    def cut(batches):
        space, kept = known.value, []

        def block(rows):
            return {"pivot": int(rows["pivot"].iloc[0]), "ring": int(rows["ring"].iloc[0]),
                    "ids": rows["id"].to_numpy(np.int64).tobytes(), "vectors": b"".join(rows["vector"]),
                    "distances": rows["distance"].to_numpy(np.float64).tobytes()}

        for batch in batches:
            rows = pd.concat([*kept, batch], ignore_index=True) if kept else batch.reset_index(drop=True)
            edges = space.edges[rows["pivot"]]
            rows["ring"] = (rows["distance"].to_numpy()[:, None] >= edges).sum(1)
            change = np.flatnonzero(np.diff(rows["pivot"] * RINGS + rows["ring"])) + 1
            ends = sorted({*change, len(rows)})
            out, start = [], 0
            for end in ends:
                while end - start >= BLOCK or (end < len(rows) and start < end):
                    to = min(end, start + BLOCK)
                    out.append(block(rows.iloc[start:to]))
                    start = to
            kept = [rows.iloc[start:]] if start < len(rows) else []
            if out:
                yield pd.DataFrame(out)
        if kept:
            yield pd.DataFrame([block(kept[0])])

    keyed = vectors.mapInArrow(key, "pivot int, distance double, id bigint, vector binary")
    spread = keyed.repartitionByRange("pivot", "distance", "id").sortWithinPartitions("pivot", "distance", "id")
    return saved(spread.mapInPandas(cut, _BLOCK), "pivots")


def _unpack(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(-1, dim)


def query_blocks(index: DataFrame, space: Space, k: int, divisor: int) -> DataFrame:
    """Queries with their first k neighbours' lowest score, once for each annulus they can reach."""
    known = index.sparkSession.sparkContext.broadcast(space)

    def run(batches):
        space = known.value
        rings = np.concatenate([np.zeros((len(space.pivots), 1)), space.edges,
                                np.full((len(space.pivots), 1), np.inf)], 1)
        ids, vectors, floors, home = [], [], [], None

        def flush():
            i, v, f = np.concatenate(ids), np.concatenate(vectors), np.concatenate(floors)
            reach, radius = space.to_pivots(space.flat(v)), space.radius(v, f)[:, None]
            low, high = (reach - radius).min(0), (reach + radius).max(0)
            pivot, ring = np.nonzero((rings[:, 1:] >= low[:, None]) & (rings[:, :-1] <= high[:, None]))
            return pd.DataFrame({"pivot": pivot.astype(np.int32), "ring": ring.astype(np.int32),
                                 "query_ids": i.tobytes(), "query_vectors": v.tobytes(), "floors": f.tobytes()})

        for batch in batches:
            for row in batch.itertuples(index=False):
                i, v = np.frombuffer(row.ids, np.int64), _unpack(row.vectors, space.dim)
                mine = np.flatnonzero(i % divisor == 0)
                if not len(mine):
                    continue
                scores, floor = space.scores(v[mine], v), np.full(len(mine), -np.inf)
                for a, q in enumerate(mine):
                    others = scores[a][i != i[q]]
                    if len(others) >= k:
                        lowest = float(np.partition(others, len(others) - k)[len(others) - k])
                        floor[a] = lowest - abs(lowest) * 2.0 ** -50
                if ids and (row.pivot != home or sum(map(len, ids)) + len(mine) > QUERIES):
                    yield flush()
                    ids, vectors, floors = [], [], []
                home = row.pivot
                ids.append(i[mine])
                vectors.append(v[mine])
                floors.append(floor)
        if ids:
            yield flush()

    return index.select("pivot", "ids", "vectors").mapInPandas(run, _QUERY)


def top_k(df: DataFrame, k: int = 20, divisor: int = 20, scale: int = 64, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """`query_id`, `rank`, `id`, `score`: the k best others of every row whose id `divisor` divides."""
    vectors = integer_vectors(df, id_col, vector_col, scale)
    space = fit_space(vectors)
    if space is None:
        return df.sparkSession.createDataFrame([], "query_id bigint, rank int, id bigint, score bigint")
    index = build_index(vectors, space)
    known = df.sparkSession.sparkContext.broadcast(space)

    def score(batches):
        space = known.value
        for batch in batches:
            out = [(np.zeros(0, np.int64),) * 3]
            for row in batch.itertuples(index=False):
                ids, vectors = np.frombuffer(row.ids, np.int64), _unpack(row.vectors, space.dim)
                distances = np.frombuffer(row.distances, np.float64)
                queries = np.frombuffer(row.query_ids, np.int64)
                points, floors = _unpack(row.query_vectors, space.dim), np.frombuffer(row.floors, np.float64)
                reach = space._distances(space.flat(points), space.pivots[row.pivot:row.pivot + 1])[:, 0]
                radius = space.radius(points, floors)
                low = np.searchsorted(distances, reach - radius, "left")
                high = np.searchsorted(distances, reach + radius, "right")
                some = np.flatnonzero(low < high)
                if not len(some):
                    continue
                start, end = low[some].min(), high[some].max()
                scores = space.scores(points[some], vectors[start:end])
                good = (scores >= floors[some][:, None]) & (ids[None, start:end] != queries[some][:, None])
                for a in np.flatnonzero(good.any(1)):
                    at = np.flatnonzero(good[a])
                    at = at[best(scores[a][at], ids[start + at], k)]
                    out.append((np.full(len(at), queries[some[a]]), ids[start + at], scores[a][at]))
            q, i, s = map(np.concatenate, zip(*out))
            yield pd.DataFrame({"query_id": q, "id": i, "score": s})

    pairs = query_blocks(index, space, k, divisor).join(index, ["pivot", "ring"])
    found = pairs.select("pivot", "query_ids", "query_vectors", "floors", "ids", "vectors", "distances").mapInPandas(
        score, "query_id bigint, id bigint, score bigint").repartition("query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "id", "score")


def query(spark, folder) -> DataFrame:
    return top_k(read(spark, folder, "embeddings")).withColumnRenamed("id", "vec_id")


ORACLE = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
  FROM usable q JOIN usable x ON q.vec_id <> x.vec_id
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
