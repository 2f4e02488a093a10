"""Operators 1 and 2: block matrix searches of a stated query set against all rows.

Both deal queries and points into blocks by a hash of the id, replicate each side over the other's blocks and work on one
(query block, point block) tile at a time; no side is broadcast, a tile is bounded, and copies of one vector spread over
the blocks by their ids. Each tile returns at most k rows a query from its heaps; a last shuffle by query merges them with
a heap again.

Operator 1 (nearest): vectors are quantised to int8 with a scale each. An int8 product tile gives every distance within
the two quantisation errors. What could still be among the k nearest is recomputed in double precision.

Operator 2 (products): points are dealt into bands of length over the whole table, and the longest band is searched first.
Its k-th score of each query then bounds all other bands: queries are sent only to bands whose length times their own can
reach it, points only to blocks of such queries, and tiles begin with that score. In a tile points go by descending length;
vectors are rotated to the axes of the SVD, the first coordinates are multiplied, and Cauchy-Schwarz bounds the rest by the
residual lengths. A tile ends where the lengths alone rule out better scores. What passes is scored with integers.

Defined results: vectors that are null, empty or hold null or non-finite components take no part (operator 1: nor zero
vectors), nor rows with a null id. Vectors of different length are never compared. A candidate id comes once a query:
repeated ids count with their best row. Ties go to the smaller id. A query without candidates gives no row; an empty table
gives none. Vectors may be long: a tile holds TILE_POINTS of them. Only the key and the vector are read, so other columns
cannot clash. Products beyond 64 bits are held to the range of a long.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith.session import drop_path, ship, written

TILE_QUERIES, TILE_POINTS, LEAST_BLOCKS = 8192, 8192, 12
#: Components that are rotated; those of longer vectors beyond them stay as they are.
ROTATED = 1024
#: Numbers of a tile's product at once.
AT_ONCE = 2_000_000
#: Shares of the points that are no longer than each band's lower end; the longest band comes first.
BANDS = (0.94, 0.75, 0.5, 0.25)


class Heaps:
    """The k best (key, smaller id first) of each query; larger keys are better."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.heaps: list[list[tuple]] = [[] for _ in range(queries)]
        self.least = np.full(queries, -np.inf)  # key of the k-th so far

    def offer(self, q: int, key, ident: int) -> None:
        heap = self.heaps[q]
        item = (key, -ident)
        if len(heap) >= self.k and item <= heap[0]:
            return
        for at, (old, other) in enumerate(heap):
            if other == -ident:
                if key > old:
                    heap[at] = item
                    heapq.heapify(heap)
                    break
                return
        else:
            heapq.heappush(heap, item) if len(heap) < self.k else heapq.heapreplace(heap, item)
        if len(heap) == self.k:
            self.least[q] = float(heap[0][0])

    def best(self, q: int) -> list[tuple]:
        return [(key, -i) for key, i in sorted(self.heaps[q], reverse=True)]


def usable(vector: Column, zero: bool) -> Column:
    """Whether a vector takes part."""
    fine = (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    fine = fine if zero else fine & F.exists(vector, lambda x: x != 0)
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def _matrix(column: pa.ChunkedArray, dim: int, kind) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.asarray(flat).astype(kind).reshape(-1, dim)


def _blocks(n: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _tiles(left: DataFrame, right: DataFrame, work, score: T.DataType) -> DataFrame:
    """left: id, vector, dim, least, qb, pb; right: id, vector, dim, pb, qb. work(query ids, vectors, least, point ids, vectors, dim) -> Heaps."""
    arrow_score = pa.int64() if isinstance(score, T.LongType) else pa.float64()

    def table(rows: list[tuple]) -> pa.Table:
        a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, arrow_score)})

    def tile(key: tuple, q: pa.Table, p: pa.Table) -> pa.Table:
        if not len(q) or not len(p):
            return table([])
        ids = np.asarray(q["id"]).tolist()
        heaps = work(np.asarray(q["id"]), q["vector"], np.asarray(q["least"]), np.asarray(p["id"]), p["vector"], key[0].as_py())
        return table([(ident, i, s) for n, ident in enumerate(ids) for s, i in heaps.best(n)])

    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", score)])
    by = ["dim", "qb", "pb"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(tile, schema)


def _merged(found: DataFrame, k: int, largest: bool) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query over all tiles; a task holds one query's heap at a time."""
    score = found.schema["score"].dataType
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64() if isinstance(score, T.LongType) else pa.float64()]
    names = ["query_id", "rank", "vec_id", "score"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from catalith.llm.search import Heaps

        query, heaps, rows = None, None, []

        def best() -> list[tuple]:
            return [] if heaps is None else [(query, rank, i, s if largest else -s) for rank, (s, i) in enumerate(heaps.best(0), 1)]

        for batch in batches:
            for q, i, s in zip(*(batch.column(c).to_pylist() for c in ("query_id", "vec_id", "score")), strict=True):
                if q != query:
                    rows += best()
                    query, heaps = q, Heaps(1, k)
                heaps.offer(0, s, i)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
        if rows := best():
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    out = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", score)])
    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, out)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale of each row, and length of each row's quantisation error (with room for rounding)."""
    top = np.abs(x).max(axis=1)
    scale = np.where(top > 0, top / 127, 1.0)
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, error + 1e-9 * np.sqrt((x**2).sum(axis=1))


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows: up to 1000 dimensions fit a float32's integers."""
    out = np.zeros((len(a), len(b)))
    for d in range(0, a.shape[1], 1000):
        out += a[:, d : d + 1000].astype(np.float32) @ b[:, d : d + 1000].astype(np.float32).T
    return out


def _nearest_tile(qid, qv, least, pid, pv, dim: int, k: int) -> Heaps:
    step = max(64, AT_ONCE // max(1, len(qid)))
    q, p = _matrix(qv, dim, np.float64), _matrix(pv, dim, np.float64)
    heaps = Heaps(len(q), k)
    qc, qs, qe = quantised(q)
    pc, ps, pe = quantised(p)
    qn = (qc.astype(np.float64) ** 2).sum(axis=1) * qs**2
    pn = (pc.astype(np.float64) ** 2).sum(axis=1) * ps**2
    for a in range(0, len(p), step):
        s = slice(a, a + step)
        with np.errstate(over="ignore", invalid="ignore"):
            near = np.sqrt(np.maximum(qn[:, None] + pn[None, s] - 2 * (qs[:, None] * ps[None, s]) * int8_products(qc, pc[s]), 0))
            near = np.where(np.isfinite(near), near, 0.0)
            room = qe[:, None] + pe[None, s] + 1e-7 * (np.sqrt(qn)[:, None] + np.sqrt(pn)[None, s])
            room = np.where(np.isfinite(room), room, np.inf)
        own = qid[:, None] == pid[None, s]
        upper = np.where(own, np.inf, near + room)
        limit = -heaps.least
        if upper.shape[1] > k:
            limit = np.minimum(limit, np.partition(upper, k - 1, axis=1)[:, k - 1] if len(set(pid[s].tolist())) == upper.shape[1] else np.inf)
        i, j = np.nonzero((near - room <= limit[:, None]) & ~own)
        for c in range(0, len(i), 65536):
            ii, jj = i[c : c + 65536], j[c : c + 65536] + a
            with np.errstate(over="ignore"):
                d = np.sqrt(((q[ii] - p[jj]) ** 2).sum(axis=1))
            for x, y, z in zip(ii.tolist(), pid[jj].tolist(), d.tolist(), strict=True):
                heaps.offer(x, -z, y)
    return heaps


def nearest(points: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k points at the smallest Euclidean distance of each query row."""
    ship(points.sparkSession)
    fine = points.where(F.col(key).isNotNull() & usable(F.col(vector), zero=False))
    wide = F.col(vector).cast("array<double>").alias("vector")
    points = fine.select(F.col(key).alias("id"), wide, F.size(vector).alias("dim"))
    queries = fine.where(is_query).select(F.col(key).alias("id"), wide, F.size(vector).alias("dim"), F.lit(float("-inf")).alias("least"))
    qb, pb = max(1, math.ceil(queries.count() / TILE_QUERIES)), max(LEAST_BLOCKS, math.ceil(points.count() / TILE_POINTS))
    left, right = queries.select("*", _blocks(qb).alias("qb"), _every(pb).alias("pb")), points.select("*", _blocks(pb).alias("pb"), _every(qb).alias("qb"))
    return _merged(_tiles(left, right, lambda *x: _nearest_tile(*x, k), T.DoubleType()), k, largest=False)


def rotation(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Right singular vectors of all vectors of each length, strongest first: sums of products, ROTATED squared numbers to the driver at most."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            flat, n = batch.column(0), np.asarray(pa.compute.list_value_length(batch.column(0)))
            for d in np.unique(n).tolist():
                x = np.asarray(flat.filter(pa.array(n == d)).flatten()).astype(np.float64).reshape(-1, d)[:, :ROTATED]
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, m in sums.items():
            i, j = np.indices(m.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, d)), pa.array(i.ravel()), pa.array(j.ravel()), pa.array(m.ravel())], names=["dim", "i", "j", "v"])

    rows = vectors.select("vector").mapInArrow(products, "dim long, i long, j long, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for d, part in rows.groupby("dim"):
        m = np.zeros((min(d, ROTATED),) * 2)
        m[part["i"], part["j"]] = part["v"]
        out[int(d)] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()
    return out


def _product_tile(qid, qv, least, pid, pv, dim: int, k: int, axes: np.ndarray, head: int) -> Heaps:
    q, p = _matrix(qv, dim, np.int64), _matrix(pv, dim, np.int64)
    heaps = Heaps(len(q), k)
    heaps.least = least.astype(np.float64)
    qf, pf = q.astype(np.float64), p.astype(np.float64)
    qn, pn = np.sqrt((qf**2).sum(axis=1)), np.sqrt((pf**2).sum(axis=1))
    order = np.lexsort((pid, -pn))
    p, pf, pn, pid = p[order], pf[order], pn[order], pid[order]
    exact = qn.max(initial=0) * pn.max(initial=0) < 2.0**62
    qr, pr = (np.hstack([x[:, : len(axes)] @ axes, x[:, len(axes) :]]) for x in (qf, pf))
    q1, q2 = qr[:, :head], np.sqrt((qr[:, head:] ** 2).sum(axis=1))
    p1, p2 = pr[:, :head], np.sqrt((pr[:, head:] ** 2).sum(axis=1))
    step = max(64, AT_ONCE // max(1, len(qid)))
    at, size = 0, 64
    while at < len(p):
        s = slice(at, at + size)
        room = 1e-9 * qn * pn[at] + 0.5
        alive = np.flatnonzero(qn * pn[at] + room >= heaps.least)
        if not len(alive):
            break
        upper = q1[alive] @ p1[s].T + q2[alive, None] * p2[None, s] + room[alive, None]
        i, j = np.nonzero((upper >= heaps.least[alive, None]) & (qid[alive, None] != pid[None, s]))
        i, j = alive[i], j + at
        for c in range(0, len(i), 65536):
            ii, jj = i[c : c + 65536], j[c : c + 65536]
            if exact:
                d = np.einsum("ij,ij->i", q[ii], p[jj])
            else:  # beyond 64 bits: Python's integers, held to the range of a long
                d = np.array([max(-(2**63), min(2**63 - 1, sum(map(int.__mul__, q[x].tolist(), p[y].tolist())))) for x, y in zip(ii, jj, strict=True)], np.int64)
            good = d >= heaps.least[ii]
            for x, y, z in zip(ii[good].tolist(), pid[jj[good]].tolist(), d[good].tolist(), strict=True):
                heaps.offer(x, z, y)
        at, size = at + size, step
    return heaps


def largest_products(points: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "vector") -> DataFrame:
    """query_id, rank, vec_id, score: the k points with the largest inner product with each query row. vector: array<long>."""
    ship(points.sparkSession)
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda n, x: n + x.cast("double") * x.cast("double")))
    fine = points.where(F.col(key).isNotNull() & usable(F.col(vector), zero=True))
    fine = fine.select(F.col(key).alias("id"), F.col(vector).alias("vector"), F.size(vector).alias("dim"), length.alias("length"), F.coalesce(is_query, F.lit(False)).alias("q"))
    fine, fine_at = written(fine)
    axes = rotation(fine)
    sums = fine.agg(F.count_if("q").alias("nq"), F.percentile_approx("length", F.array(*map(F.lit, BANDS))).alias("ends")).first()
    ends = sums["ends"] or [0.0] * len(BANDS)
    band = F.lit(len(BANDS))
    for i in reversed(range(len(BANDS))):
        band = F.when(F.col("length") > ends[i], i).otherwise(band)
    fine = fine.withColumn("band", band)
    # a row for each band: its size and greatest length
    bands = {r["band"]: (r["n"], r["most"]) for r in fine.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("most")).collect()}
    qb = max(1, math.ceil(sums["nq"] / TILE_QUERIES))

    def work(qid, qv, least, pid, pv, dim):
        return _product_tile(qid, qv, least, pid, pv, dim, k, axes[dim], max(1, dim // 2))

    def searched(queries: DataFrame, some: list[int]) -> DataFrame:
        """Tiles of the queries (with least) and the points of some bands. Block numbers of a point run on from band to band."""
        first, blocks, start = {}, {}, 0
        for b in some:
            first[b], blocks[b] = start, max(LEAST_BLOCKS if len(some) == 1 else 1, math.ceil(bands[b][0] / TILE_POINTS))
            start += blocks[b]
        reach = [F.when(F.col("length") * bands[b][1] * (1 + 1e-9) + 1 >= F.col("least"), F.sequence(F.lit(first[b]), F.lit(first[b] + blocks[b] - 1))).otherwise(F.array().cast("array<int>")) for b in some]
        left = queries.select("id", "vector", "dim", "least", _blocks(qb).alias("qb"), F.explode(F.flatten(F.array(*reach))).alias("pb"))
        left, left_at = written(left)
        asked = left.select(F.col("qb").alias("asks"), F.col("pb").alias("asked")).distinct()
        pb = F.lit(None).cast("int")
        for b in some:
            pb = F.when(F.col("band") == b, F.lit(first[b]) + _blocks(blocks[b])).otherwise(pb)
        right = fine.where(F.col("band").isin(some)).select("id", "vector", "dim", pb.alias("pb")).join(asked.hint("merge"), F.col("pb") == F.col("asked"))
        right = right.select("id", "vector", "dim", "pb", F.col("asks").alias("qb"))
        out, _ = written(_tiles(left, right, work, T.LongType()))
        drop_path(points.sparkSession, left_at)
        return out

    queries = fine.where("q").select("id", "vector", "dim", "length")
    order = sorted(bands)
    if not order:
        return _merged(points.sparkSession.createDataFrame([], "query_id long, vec_id long, score long"), k, largest=True)
    found = searched(queries.withColumn("least", F.lit(float("-inf"))), order[:1])
    if order[1:]:
        longest, _ = written(_merged(found, k, largest=True))
        # the k-th score so far; a query with fewer than k candidates has none
        kth = longest.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("kth"))
        with_least = queries.join(kth.hint("merge"), "id", "left").withColumn("least", F.coalesce("kth", F.lit(float("-inf")))).drop("kth")
        found = longest.select("query_id", "vec_id", "score").unionByName(searched(with_least, order[1:]))
    drop_path(points.sparkSession, fine_at)
    return _merged(found, k, largest=True)

