"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Each tree splits at the median of a projection that starts as the difference of two random points
and is turned towards the means of the two halves. One priority queue per query, shared by all
trees, visits leaves in the order of the margin by which the query misses them; the candidates
of the visited leaves are scored exactly. To serve inner products the trees see each vector with one
more component that evens out the norms.

The trees are fitted on a sample by hash of about ``SAMPLE`` vectors, or ``PER_LEAF`` for each leaf where that is more, never more than twice that;
their depth follows the table, so that a leaf holds about ``LEAF_ROWS`` rows (down to ``DEPTHS`` levels, which bounds the sample). Every distinct
row is indexed in every tree. How many leaves a query visits is measured: the least number that finds ``GOAL`` of the true
neighbours of sampled queries among the sample, where the neighbours sought there are as deep as ``k`` is in the whole table. A leaf
of many rows is split into blocks, so that copies of one vector don't meet in one task. Within a block a matrix product finds
what may be among the ``k`` best (with a margin for rounding), and those are scored again pair by pair, components added in their order, so that
equal vectors score equally wherever they lie.

Defined results: vectors that are null, zero, of another length than most (of equally common lengths the shorter), or with null or
non-finite components take no part, nor do null ids; equal scores go by the smaller id; equal rows are one; of rows with one id the best counts;
with fewer than ``k`` other ids all are returned; an empty table gives no rows; other columns, of any name, are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import wordblocks as wb
from .scratch import path_of, released, written

K = 20
TREES = 3
LEAF_ROWS = 2048
DEPTHS = (4, 13)
SAMPLE = 20_000
PER_LEAF = 16
SAMPLE_QUERIES = 200
GOAL = 0.94
BLOCK_ROWS = 4096
SEED = 11
Forest = list[dict[int, tuple[np.ndarray, float]]]


def _usable(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a whole, finite vector of that length that isn't zero, and those vectors."""
    sizes = np.nan_to_num(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(float), nan=-1)
    rows = np.flatnonzero(sizes == length)
    flat = column.take(pa.array(rows)).flatten()
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, length)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return rows[good], x[good]


def _packed(x: np.ndarray) -> pa.Array:
    """Vectors as binaries."""
    data = np.ascontiguousarray(x)
    edges = np.arange(len(x) + 1, dtype=np.int32) * data.itemsize * data.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(edges), pa.py_buffer(data)])


def _matrix(column: pa.Array | pa.ChunkedArray, kind: str, length: int) -> np.ndarray:
    """Packed vectors in double precision."""
    buf, _ = wb.raw(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    return np.frombuffer(buf.tobytes(), kind).reshape(-1, length).astype(np.float64)


def pairwise(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, components added in their order."""
    out = np.zeros(len(q))
    for k in range(q.shape[1]):
        out += q[:, k] * v[:, k]
    return out


def augmented(x: np.ndarray, limit: float) -> np.ndarray:
    """Vectors of one norm, ``limit``, in one dimension more: nearest is then largest inner product."""
    return np.concatenate([x, np.sqrt(np.maximum(0, limit**2 - (x * x).sum(1)))[:, None]], 1)


def grow(s: np.ndarray, rng: np.random.Generator, depth: int) -> dict[int, tuple[np.ndarray, float]]:
    """Node number -> (direction, threshold); children of n are 2n and 2n + 1, those without an entry are leaves."""
    tree, rows = {}, {1: np.arange(len(s))}
    for n in range(1, 1 << depth):
        i = rows.pop(n, None)
        if i is None or len(i) < 8:
            continue
        a, b = rng.choice(len(i), 2, replace=False)
        w = s[i[a]] - s[i[b]]
        for _ in range(4):
            p = s[i] @ w
            up = p > np.median(p)
            if not up.any() or up.all():
                break
            w = s[i[up]].mean(0) - s[i[~up]].mean(0)
        norm = np.linalg.norm(w)
        if not norm:
            continue
        p = s[i] @ (w := w / norm)
        cut = float(np.median(p))
        if not (p > cut).any():
            continue
        tree[n] = (w, cut)
        rows[2 * n], rows[2 * n + 1] = i[p <= cut], i[p > cut]
    return tree


def leaves(tree: dict[int, tuple[np.ndarray, float]], x: np.ndarray) -> np.ndarray:
    at = np.ones(len(x), np.int64)
    for n, (w, cut) in sorted(tree.items()):
        here = np.flatnonzero(at == n)
        if len(here):
            at[here] = 2 * n + (x[here] @ w > cut)
    return at


def margins(forest: Forest, q: np.ndarray) -> list[tuple[dict[int, int], np.ndarray]]:
    """Per tree the columns of its nodes, and by query and node the signed distance to the split."""
    out = []
    for tree in forest:
        nodes = list(tree)
        away = q @ np.stack([tree[n][0] for n in nodes], 1) - np.array([tree[n][1] for n in nodes]) if nodes else np.zeros((len(q), 0))
        out.append(({n: k for k, n in enumerate(nodes)}, away))
    return out


def visited(away: list[tuple[dict[int, int], np.ndarray]], i: int, count: int, sizes: dict[tuple[int, int], int], least: int, firsts: dict[tuple[int, int], int] | None = None) -> list[tuple[int, int]]:
    """The first ``count`` non-empty leaves of query ``i`` in order of margin, and more until one tree gave ``least`` ids.

    Where ids have several vectors, ``firsts`` counts each id in one leaf a tree; else rows are ids.
    """
    sides = [a[i].tolist() for _, a in away]
    queue = [(0.0, t, 1) for t in range(len(away))]
    got, rows = [], [0] * len(away)
    while queue and (len(got) < count or max(rows) < least):
        miss, t, n = heapq.heappop(queue)
        column = away[t][0].get(n)
        if column is None:
            if size := sizes.get((t, n), 0):
                got.append((t, n))
                rows[t] += size if firsts is None else firsts.get((t, n), 0)
            continue
        side = sides[t][column]
        near = 2 * n + (side > 0)
        heapq.heappush(queue, (miss, t, near))
        heapq.heappush(queue, (max(miss, abs(side)), t, near ^ 1))
    return got


def enough_leaves(forest: Forest, s: np.ndarray, own: np.ndarray, limit: float, k: int, rng: np.random.Generator) -> int:
    """The least number of leaves, of a rising series, that reaches ``GOAL`` on the sample."""
    n = len(s)
    if n < 2:
        return 1
    place = [leaves(t, s) for t in forest]
    sizes = {(t, int(leaf)): int(c) for t, p in enumerate(place) for leaf, c in zip(*np.unique(p, return_counts=True), strict=True)}
    queries = rng.choice(n, min(n, SAMPLE_QUERIES), replace=False)
    k = min(k, n - 1)
    order = {}
    away = margins(forest, np.pad(own[queries], ((0, 0), (0, 1))))
    for j, i in enumerate(queries):
        score = own @ own[i]
        score[i] = -np.inf
        order[i] = (np.argpartition(-score, k - 1)[:k], visited(away, j, 1 << 30, sizes, 0))
    total, count = len(sizes), 1
    while count < total:
        found = 0.0
        for i in queries:
            true, path = order[i]
            seen = np.zeros(len(true), bool)
            for t, leaf in path[:count]:
                seen |= place[t][true] == leaf
            found += seen.mean()
        if found >= GOAL * len(queries):
            break
        count += max(1, count // 8)
    return min(count, total)


def nearest(vectors: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = SEED) -> DataFrame:
    """For each row of ``vectors`` where ``queries`` holds: ``query_id``, ``rank``, ``vec_id``, ``score``."""
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    kind = "<f4" if vectors.schema[vec_col].dataType.elementType.typeName() == "float" else "<f8"
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>" if kind == "<f4" else "array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    plain = plain.where("id is not null and v is not null")
    common = plain.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").limit(1).collect()
    if not common or not common[0][0]:
        return spark.createDataFrame([], out)
    length = common[0][0]

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = _usable(b.column(1), length)
            at = pa.array(rows)
            yield pa.record_batch([b.column(0).take(at), _packed(x.astype(kind)), b.column(2).take(at), pa.array(np.sqrt((x.astype(float) ** 2).sum(1)))], names=["id", "v", "asks", "norm"])

    rows = plain.mapInArrow(cleaned, "id long, v binary, asks boolean, norm double").groupBy("id", "v").agg(F.max("asks").alias("asks"), F.max("norm").alias("norm"))
    good = written(rows)
    released(spark)
    limit, n, n_ids = good.agg(F.max("norm"), F.count("*"), F.count_distinct("id")).first()
    if not n:
        return spark.createDataFrame([], out)
    depth = min(max(round(math.log2(max(1, n / LEAF_ROWS))), DEPTHS[0]), DEPTHS[1])
    wanted = max(SAMPLE, PER_LEAF << depth)
    chance = F.pmod(F.xxhash64(F.lit(seed), "id", "v"), F.lit(1 << 40)) < int(min(1.0, wanted / n) * (1 << 40))  # as many rows on average
    sample = good.where(chance).select("id", "v").limit(2 * wanted).toArrow().sort_by([("id", "ascending"), ("v", "ascending")])
    own = _matrix(sample.column("v"), kind, length)
    rng = np.random.default_rng(seed)
    s = augmented(own, limit)
    forest = [grow(s, rng, depth) for _ in range(TREES)]
    count = enough_leaves(forest, s, own, limit, max(1, round(k * len(own) / n)), rng)
    shared = spark.sparkContext.broadcast(forest)  # at most TREES * 2^DEPTHS[1] directions

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = augmented(_matrix(b.column(1), kind, length), limit)
                for t, tree in enumerate(shared.value):
                    yield pa.record_batch([b.column(0), b.column(1), pa.array(np.full(len(x), t, np.int32)), pa.array(leaves(tree, x))], names=["id", "v", "tree", "leaf"])

    indexed = good.select("id", "v").mapInArrow(index, "id long, v binary, tree int, leaf long")
    sizes = {(r[0], r[1]): r[2] for r in indexed.groupBy("tree", "leaf").count().collect()}  # at most TREES * 2^DEPTHS[1] rows
    firsts = None
    if n_ids < n:
        firsts = {(r[0], r[1]): r[2] for r in indexed.groupBy("tree", "id").agg(F.min("leaf").alias("leaf")).groupBy("tree", "leaf").count().collect()}  # as sizes
    known = spark.sparkContext.broadcast((sizes, firsts))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                b, at, tree, leaf, block = whole.slice(a, 512), [], [], [], []
                away = margins(shared.value, np.pad(_matrix(b.column(1), kind, length), ((0, 0), (0, 1))))
                held, ids = known.value
                for i in range(b.num_rows):
                    for t, f in visited(away, i, count, held, k + 1, ids):
                        for part in range(-(-held[t, f] // BLOCK_ROWS)):
                            at.append(i)
                            tree.append(t)
                            leaf.append(f)
                            block.append(part)
                at = pa.array(at, pa.int64())
                yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), pa.array(tree, pa.int32()), pa.array(leaf, pa.int64()), pa.array(block, pa.int64())], names=["id", "v", "tree", "leaf", "block"])

    probes = good.where("asks").select("id", "v").mapInArrow(probe, "id long, v binary, tree int, leaf long, block long")
    blocks = spark.createDataFrame([(t, f, -(-c // BLOCK_ROWS)) for (t, f), c in sizes.items()], "tree int, leaf long, blocks long")
    held = indexed.join(F.broadcast(blocks), ["tree", "leaf"]).select("id", "v", "tree", "leaf", F.pmod(F.xxhash64("id", "v"), "blocks").alias("block"))  # bounded as sizes
    cells = held.withColumn("asks", F.lit(False)).unionByName(probes.withColumn("asks", F.lit(True)))
    margin = 8 * length * np.finfo(float).eps * limit**2

    def best(_key: tuple[pa.Scalar, ...], g: pa.Table) -> pa.Table:
        asks, ids = g.column("asks").to_numpy(), g.column("id").to_numpy()
        v = _matrix(g.column("v"), kind, length)
        m, q = np.flatnonzero(~asks), np.flatnonzero(asks)
        m = m[np.argsort(ids[m], kind="stable")]
        own, first = ids[m], np.unique(ids[m], return_index=True)[1]
        qs, vs, sc = [], [], []
        for a in range(0, len(q), 256):
            part = q[a : a + 256]
            score = v[part] @ v[m].T
            score[ids[part][:, None] == own[None, :]] = -np.inf
            if len(first) > k:  # the k-th best id, with what rounding may have put below it
                each = score if len(first) == len(m) else np.maximum.reduceat(score, first, axis=1)
                edge = np.partition(each, len(first) - k, axis=1)[:, len(first) - k]
                i, j = np.nonzero((score >= edge[:, None] - margin) & (score > -np.inf))
            else:
                i, j = np.nonzero(score > -np.inf)
            value = np.concatenate([pairwise(v[part[i[c : c + 65536]]], v[m[j[c : c + 65536]]]) for c in range(0, max(1, len(i)), 65536)])
            order = np.lexsort((-value, own[j], i))  # of an id's vectors the best
            order = order[np.concatenate([[True], (np.diff(i[order]) != 0) | (np.diff(own[j[order]]) != 0)])[: len(order)]]
            order = order[np.lexsort((own[j[order]], -value[order], i[order]))]
            i, j, value = i[order], j[order], value[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            qs.append(ids[part][i[keep]])
            vs.append(own[j[keep]])
            sc.append(value[keep])
        cat = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
        return pa.table([cat(qs, pa.int64()), cat(vs, pa.int64()), cat(sc, pa.float64())], names=["query_id", "vec_id", "score"])

    found = cells.groupBy("tree", "leaf", "block").applyInArrow(best, "query_id long, vec_id long, score double")
    once = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # at most k of each block that a query visits
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(path_of(sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)
