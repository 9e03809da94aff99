"""Near-duplicate documents by an LSH forest over MinHash signatures.

Documents with equal shingle sets form a class; only one of a class goes on.
Each of `TREES` orders reads the signature from another place; classes whose
orders begin with the same `DEPTH` minima share a region of that tree. A region of
up to `REGION` classes is compared as a whole. The classes of a larger one are sorted
by the whole signature in the tree's order, with the class as tie-break, and each is
compared with the `REGION` before it and after it, over the edges of partitions too:
those are its neighbours of longest common prefix, so a class that differs from a
crowd at any depth still meets the part of it that it shares most with. Among those
a class is paired with the earlier one that is most alike; pairs are confirmed on full
shingle sets, and links grow to components. A second pass confirms every other
pair that met, is alike and is not yet in one component, so that no link is lost while
thousands of near copies aren't expanded into all pairs.

A pair of similarity 0.85 misses a first region in every tree with a chance below
1e-10; likeness is estimated from all minima and lets a pair pass from 0.16 below
the threshold; a pair at exactly 0.85 is ruled out, in all trees at once, with a chance
of 3e-6.

Defined results: a text without words has no shingles, is linked with nothing and
stays; a text of fewer words than a shingle is one shingle; rows without an id
take no part and stay; repeated rows are of one class; rows that repeat the
smallest id of a component are all kept by `near_duplicates`, one of them by
`drop_near_duplicates`; extra columns are ignored or kept; an empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import slices
from .common import byte_class, hashed_words, mix, powers, read, saved, text_slices
from .components import components

SHINGLE, THRESHOLD = 5, 85
HASHES, TREES, DEPTH, REGION = 128, 32, 4, 1024
#: How far the estimated likeness may lie below the threshold.
SLACK = 0.16
WORD = byte_class([(0x20, 0x20), (0x09, 0x0D)], inside=False)

_rng = np.random.default_rng(5)
_FACTORS = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_STEP = 0xD6E8FEB86659FD93
_PLACES = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingle_sets(column, size: int):
    """Yield (row, sorted distinct shingle hashes) of every text."""
    for first, data, starts, _ in text_slices(column):
        hashes, at = hashed_words(data, WORD)
        edges = np.searchsorted(at, np.append(starts, len(data)))
        weights = powers(_STEP, size)
        for i in range(len(starts)):
            words = hashes[edges[i]:edges[i + 1]]
            n = min(size, len(words))
            if not n:
                yield first + i, words
                continue
            sums = np.zeros(len(words) - n + 1, np.uint64)
            for j in range(n):
                sums += words[j:len(words) - n + 1 + j] * weights[j]
            yield first + i, np.unique(mix(sums + np.uint64(n)))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of `HASHES` hash functions, 32 bits each; of non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(((flat * _FACTORS[k] + _OFFSETS[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """`doc_id`, `n_shingles`, a 128-bit digest of the set, and the signature; stored."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [s for _, s in shingle_sets(part.column("text"), size)]
                counts = np.array([len(s) for s in sets], np.int64)
                digest = np.array([[mix(s).sum(), mix(s ^ np.uint64(_STEP)).sum()] for s in sets],
                                  np.uint64).reshape(-1, 2).view(np.int64)
                filled = [s for s in sets if len(s)]
                rows = iter(signatures(filled)) if filled else iter(())
                signature = [next(rows).tobytes() if n else None for n in counts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(counts), pa.array(digest[:, 0]), pa.array(digest[:, 1]),
                     pa.array(signature, pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "signature"])

    return saved(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, signature binary"), "sketches")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def tree_order(tree):
    """The places of the signature in a tree's order, which starts at its own one."""
    return (np.arange(HASHES) + tree * (HASHES // TREES)) % HASHES


def region_keys(signature: np.ndarray, tree: int) -> np.ndarray:
    """A hash of the first `DEPTH` values in a tree's order."""
    key = np.full(len(signature), tree, np.uint64)
    for i, place in enumerate(tree_order(tree)[:DEPTH]):
        key = key + mix(signature[:, place].astype(np.uint64) + _PLACES[i])
    return mix(key).view(np.int64)


def placed(classes: DataFrame) -> DataFrame:
    """`tree`, `region`, `class_id` of every class in every tree."""
    def run(batches):
        for batch in batches:
            signature = _matrix(batch.column("signature"))
            for tree in range(TREES):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(signature), tree, np.int32)), pa.array(region_keys(signature, tree)),
                     batch.column("class_id")], ["tree", "region", "class_id"])

    return classes.select("class_id", "signature").mapInArrow(run, "tree int, region bigint, class_id bigint")


def in_order(crowd: DataFrame, classes: DataFrame) -> DataFrame:
    """`region`, `count`, `class_id`, and `place`, from 0, in the sorted order of the region's whole signatures."""
    def turn(batches):
        for batch in batches:
            tree = batch.column("tree").to_numpy().astype(np.int64)
            turned = np.take_along_axis(_matrix(batch.column("signature")), tree_order(tree[:, None]), 1).astype(">u4")
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("region", "count", "class_id")),
                 pa.array([r.tobytes() for r in turned], pa.binary())], ["region", "count", "class_id", "turned"])

    def number(batches):
        last, n = None, 0  # the region that goes on from the batch before, and its rows so far
        for batch in batches:
            region = batch.column("region").to_numpy()
            if not len(region):
                continue
            fresh = np.diff(region, prepend=region[:1]) != 0
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(region)), 0))
            place = np.arange(len(region)) - begin + np.where(begin == 0, n if region[0] == last else 0, 0)
            last, n = region[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], ["region", "count", "class_id", "place"])

    rows = crowd.join(classes.select("class_id", "signature"), "class_id").select(
        "tree", "region", "count", "class_id", "signature").mapInArrow(
        turn, "region bigint, count bigint, class_id bigint, turned binary")
    order = ["region", "turned", "class_id"]
    numbered = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("region", "count", "class_id").mapInArrow(
        number, "region bigint, count bigint, class_id bigint, place bigint").withColumn(
        slices.PART, F.spark_partition_id()), "in-order")
    sizes = numbered.groupBy(slices.PART, "region").agg(F.count(F.lit(1)).alias("n"))
    coming = slices.carried(sizes, ["region"], _before=F.sum("n").over(slices.earlier(["region"])))
    return slices.carry(numbered, coming, ["region"]).select(
        "region", "count", "class_id", (F.col("place") + F.coalesce("_before", F.lit(0))).alias("place"))


def regions(classes: DataFrame) -> DataFrame:
    """`region`, `class_id`, `own` of all groups of two classes or more to be compared: an own
    class with every other. A crowded region is dealt out as runs of its sorted
    order, each with the run before it, whose classes aren't own there."""
    rows = saved(placed(classes), "placed")
    counts = saved(rows.groupBy("region").count().filter("count > 1"), "counts")
    small = rows.join(counts.filter(F.col("count") <= REGION), "region").select("region", "class_id", F.lit(True).alias("own"))
    crowded = counts.filter(F.col("count") > REGION)
    if crowded.isEmpty():
        return small
    run = F.floor(F.col("place") / REGION)
    goes_on = (run + 1) * REGION < F.col("count")
    runs = F.array(F.struct(run.alias("run"), F.lit(True).alias("own")),
                   F.when(goes_on, F.struct((run + 1).alias("run"), F.lit(False).alias("own"))))
    dealt = in_order(rows.join(crowded, "region"), classes).select("region", "class_id", F.explode(runs).alias("r"))
    return small.union(dealt.filter("r IS NOT NULL").select(F.xxhash64("region", "r.run"), "class_id", "r.own"))


def members(classes: DataFrame, found: DataFrame) -> DataFrame:
    """Regions with what likeness is estimated from: set sizes and a byte of each minimum."""
    def run(batches):
        for batch in batches:
            low = np.ascontiguousarray((_matrix(batch.column("signature")) & 0xFF).astype(np.uint8))
            yield pa.RecordBatch.from_arrays(
                [batch.column("class_id"), batch.column("n_shingles"), pa.array([r.tobytes() for r in low], pa.binary())],
                ["class_id", "n_shingles", "brief"])

    small = saved(classes.select("class_id", "n_shingles", "signature").mapInArrow(
        run, "class_id bigint, n_shingles bigint, brief binary"), "brief")
    return saved(found.join(small, "class_id"), "members")


def alike(brief: np.ndarray, sizes: np.ndarray, i: int, low: float, threshold: int) -> np.ndarray:
    """Estimated likeness of row i to the rows before it; 0 where sizes or estimate rule a link out."""
    equal = (brief[:i] == brief[i]).view(np.uint64).sum(1)  # a count in each of eight bytes, up to 16
    same = (equal * np.uint64(0x0101010101010101) >> np.uint64(56)) / HASHES
    estimate = (same - 1 / 256) / (1 - 1 / 256)  # two different minima share a byte now and then
    small, large = np.minimum(sizes[:i], sizes[i]), np.maximum(sizes[:i], sizes[i])
    return np.where((estimate >= low) & (100 * small >= threshold * large), estimate, 0)


def _by_region(rows: DataFrame, pairs) -> DataFrame:
    """Distinct pairs that `pairs(ids, sizes, briefs, components, sets, first)` names in each region;
    the rows from `first` on are own."""
    def run(batches):
        kept = None

        def work(table):
            region = table.column("region").to_numpy()
            edges = np.flatnonzero(np.diff(region, prepend=region[:1] - 1, append=region[-1:] + 1)) if len(region) else []
            ids, sizes = table.column("class_id").to_numpy(), table.column("n_shingles").to_numpy()
            brief = np.frombuffer(b"".join(table.column("brief").to_pylist()), np.uint8).reshape(-1, HASHES)
            component = table.column("component").to_numpy()
            sets = table.column("shingles")
            own = table.column("own").to_numpy(zero_copy_only=False)
            found = [np.zeros((0, 2), np.int64)]
            for a, b in zip(edges[:-1], edges[1:]):
                found += pairs(ids[a:b], sizes[a:b], brief[a:b], component[a:b], sets.slice(a, b - a),
                               int(np.count_nonzero(~own[a:b])))
            found = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch] if kept is None else [*kept, batch]).combine_chunks()
            region = table.column("region").to_numpy()
            done = int(np.searchsorted(region, region[-1])) if len(region) else 0
            if done:
                yield work(table.slice(0, done).combine_chunks())
            kept = table.slice(done).to_batches()
        if kept:
            yield work(pa.Table.from_batches(kept).combine_chunks())

    columns = ["region", "own", "class_id", "n_shingles", "brief", "component", "shingles"]
    ordered = rows.select(*columns).repartition("region").sortWithinPartitions("region", "own", "class_id")
    return ordered.mapInArrow(run, "a bigint, b bigint").distinct()


def nearest_pairs(rows: DataFrame, low: float, threshold: int) -> DataFrame:
    """Each own class of a region with the one before it that is most alike; and
    every class that is alike to another, with itself."""
    def pairs(ids, sizes, brief, _, __, first):
        found, any_ = [], np.zeros(len(ids), bool)
        for i in range(max(1, first), len(ids)):
            near = alike(brief, sizes, i, low, threshold)
            j = int(near.argmax())
            if near[j] > 0:
                found.append([ids[j], ids[i]])
                any_[:i] |= near > 0
                any_[i] = True
        return [np.array(found, np.int64), np.stack([ids[any_], ids[any_]], 1)] if found else []

    plain = rows.withColumn("component", F.col("class_id")).withColumn("shingles", F.lit(None).cast("binary"))
    return saved(_by_region(plain, pairs), "nearest")


def open_pairs(sizes, brief, component, first: int, low: float, threshold: int) -> np.ndarray:
    """Places (j < i, i own) of a region's classes that are alike and in different components."""
    found = [np.zeros((0, 2), np.int64)]
    if (component != component[0]).any():
        for i in range(max(1, first), len(sizes)):
            near = np.flatnonzero((alike(brief, sizes, i, low, threshold) > 0) & (component[:i] != component[i]))
            found.append(np.stack([near, np.full(len(near), i)], 1))
    return np.concatenate(found)


def shared_counts(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets with each other, by products of their indicator rows."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count[place] > 1
    owner, (_, column) = owner[several], np.unique(place[several], return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [start, start + width])
        rows = np.zeros((len(sets), min(width, int(column[-1]) + 1 - start)), np.float32)
        rows[owner[a:b], column[a:b] - start] = 1
        out += rows @ rows.T
    return out


def open_links(rows: DataFrame, sets: DataFrame, low: float, threshold: int) -> DataFrame:
    """Links between components of a region, enough to join those that have any.

    All open pairs are confirmed on full sets where the region is at hand, so
    only links leave the task, not pairs.
    """
    def concerned(ids, sizes, brief, component, _, first):
        ids = ids[np.unique(open_pairs(sizes, brief, component, first, low, threshold))]
        return [np.stack([ids, ids], 1)] if len(ids) else []

    def links(ids, sizes, brief, component, shingles, first):
        pairs = open_pairs(sizes, brief, component, first, low, threshold)
        if not len(pairs):
            return []
        which, place = np.unique(pairs, return_inverse=True)
        place = place.reshape(pairs.shape)
        both = shared_counts([np.frombuffer(s, np.uint64) for s in shingles.take(pa.array(which)).to_pylist()])
        both = both[place[:, 0], place[:, 1]].astype(np.int64)
        union = sizes[pairs].sum(1) - both
        root = {c: c for c in component.tolist()}

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        out = []
        for j, i in pairs[100 * both >= threshold * union].tolist():
            a, b = find(int(component[j])), find(int(component[i]))
            if a != b:
                root[a] = b
                out.append([ids[j], ids[i]])
        return [np.array(out, np.int64)] if out else []

    nothing = F.lit(None).cast("binary")
    few = _by_region(rows.withColumn("shingles", nothing), concerned).select(F.col("a").alias("class_id"))
    some = saved(sets.join(few, "class_id", "left_semi"), "open")
    return saved(_by_region(rows.join(some, "class_id", "left"), links), "links")


def class_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """`class_id`, `shingles` (sorted 64-bit hashes) of the wanted documents, stored."""
    def run(batches):
        for batch in batches:
            ids = batch.column("class_id")
            for at in range(0, batch.num_rows, 256):
                sets = [s.tobytes() for _, s in shingle_sets(batch.column("text").slice(at, 256), size)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, 256), pa.array(sets, pa.binary())], ["class_id", "shingles"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("class_id"), F.col(text_col).alias("text"))
    once = rows.join(wanted, "class_id", "left_semi").dropDuplicates(["class_id"])
    return saved(once.mapInArrow(run, "class_id bigint, shingles binary"), "sets")


def confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    def run(batches):
        for batch in batches:
            left, right = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            good = []
            for x, y in zip(left, right):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    first = pairs.join(sets.select(F.col("class_id").alias("a"), F.col("shingles").alias("x")), "a")
    both = first.join(sets.select(F.col("class_id").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                    threshold: int = THRESHOLD) -> DataFrame:
    """Per document: `doc_id`, `n_shingles`, `component_id`, `kept`."""
    drawn = sketches(docs, id_col, text_col, size)
    full = drawn.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = saved(full.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("class_id")), "classes")
    least = -(-threshold // (100 - threshold)) if threshold < 100 else 1 << 40  # sets smaller than that link to equals only
    able = classes.filter(F.col("n_shingles") >= least).select("d1", "d2", F.col("class_id").alias("doc_id"))
    signed = saved(full.join(able, ["d1", "d2", "doc_id"], "left_semi").select(
        F.col("doc_id").alias("class_id"), "n_shingles", "signature"), "signed")
    low = threshold / 100 - SLACK
    rows = members(signed, regions(signed))
    nearest = nearest_pairs(rows, low, threshold)
    wanted = nearest.filter("a = b").select(F.col("a").alias("class_id"))
    sets = class_sets(docs, wanted, id_col, text_col, size)
    links = saved(confirm(nearest.filter("a < b"), sets, threshold), "links")
    roots = components(links)
    known = saved(rows.join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn(
        "component", F.coalesce("component", "class_id")), "known")
    more = open_links(known, sets, low, threshold)
    if not more.isEmpty():
        roots = components(roots.toDF("a", "b").union(more))
    label = saved(classes.join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "d1", "d2", "n_shingles", F.coalesce("component", "class_id").alias("component_id")), "labels")
    linked = full.select("doc_id", "d1", "d2", "n_shingles").join(label, ["d1", "d2", "n_shingles"]).select(
        "doc_id", "n_shingles", "component_id")
    alone = drawn.filter("n_shingles = 0 OR doc_id IS NULL").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                         threshold: int = THRESHOLD) -> DataFrame:
    """The documents without those that have a near duplicate of smaller id, all columns as they are."""
    inner = [f"c{i}" for i in range(len(docs.columns))]
    key = inner[docs.columns.index(id_col)]
    text = inner[docs.columns.index(text_col)]
    stay = near_duplicates(docs, id_col, text_col, size, threshold).filter("kept AND doc_id IS NOT NULL").select(
        F.col("doc_id").alias(key))
    plain = docs.toDF(*inner)
    with_id = plain.join(stay, key, "left_semi")
    # rows that repeat an id and a text are one document
    once = with_id.dropDuplicates([key, text])
    return once.select(*inner).union(plain.filter(F.col(key).isNull())).toDF(*docs.columns)


def query(spark, folder) -> DataFrame:
    return near_duplicates(read(spark, folder, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS both
  FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT reach.doc_id, shared.b FROM reach JOIN shared ON shared.a = reach.other
), roots AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN roots USING (doc_id)
"""
