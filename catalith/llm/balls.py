"""Operator 11: ball k-means over integer vectors.

A cluster is a ball: its centroid and the largest distance of a member. A centroid can take members of a ball only if half the
distance between the two centroids is within the ball's radius; those are the ball's neighbours. A member nearer to its own
centroid than half the way to the nearest neighbour is in the stable core and stays as it is. Other members lie in an annulus
between half the ways to two neighbours that follow each other by distance, and are compared only with the neighbours on the
inner side of it. The comparisons are exact: twice a distance is held against a distance between centroids by their squares,
in integers, and a centroid just as near as the own one always passes, so that ties are decided as by a full search.

One pass a round: vectors are read with their cluster, written with the new one; sums, counts and radii follow from grouped
sums that Spark combines before its shuffle. The radius about a moved centroid is bounded by the old radius plus the way the
centroid went, so no pass is spent on it. What reaches the driver is k centroids, sums and radii.

Defined results: vectors that are null, hold null or non-finite components or have another number of components take no part.
Ties go to the smaller cluster. Repeated rows are members each; rows with a null id are members, but start no cluster while
others can. Fewer vectors than clusters make fewer clusters. An empty table gives an empty table. A component beyond 2^31
or vectors of which squared distances could leave 62 bits raise an error. Only the key and the vector are read, so other
columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith.session import drop_path, ship, written

#: Rows of a task that are worked on at once.
AT_ONCE = 65_536


@dataclass(frozen=True)
class Balls:
    """Centroids (k, dim) and radii, as whole numbers not below the true ones; -1: no member yet known."""

    centres: np.ndarray
    radii: tuple[int, ...]

    def between(self) -> np.ndarray:
        """Squared distances between all centroids."""
        return np.stack([((self.centres - c) ** 2).sum(1) for c in self.centres])

    def neighbours(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each ball: its neighbours, nearest first, and their squared distances."""
        out = []
        for i, apart in enumerate(self.between()):
            order = np.lexsort((np.arange(len(apart)), apart))
            order = order[(order != i) & (apart[order] <= 4 * self.radii[i] ** 2)]
            out.append((order, apart[order]))
        return out


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of all centroids, smaller numbers first, and the squared distance."""
    best, least = np.zeros(len(x), np.int64), ((x - centres[0]) ** 2).sum(1)
    for j in range(1, len(centres)):
        d = ((x - centres[j]) ** 2).sum(1)
        closer = d < least
        best[closer], least[closer] = j, d[closer]
    return best, least


def reassign(x: np.ndarray, own: np.ndarray, balls: Balls, near: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of members, their squared distance, and how many distances to other centroids were computed."""
    least = ((x - balls.centres[own]) ** 2).sum(1)
    best, tried = own.copy(), 0
    for i, (others, apart) in enumerate(near):
        mine = np.flatnonzero(own == i)
        if not len(mine) or not len(others):
            continue
        annulus = np.searchsorted(apart, 4 * least[mine], side="right")  # 0: the stable core
        for n, j in enumerate(others.tolist()):
            inside = annulus > n
            rows = mine[inside]
            if not len(rows):
                break
            d = ((x[rows] - balls.centres[j]) ** 2).sum(1)
            tried += len(rows)
            closer = (d < least[rows]) | ((d == least[rows]) & (j < best[rows]))
            best[rows[closer]], least[rows[closer]] = j, d[closer]
    return best, least, tried


def usable(vector: Column, dim: int) -> Column:
    fine = (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def _pass(rows: DataFrame, balls: Balls, first: bool) -> DataFrame:
    """rows (id, vector, cluster) with the nearest centroid as cluster, and its squared distance."""
    dim = balls.centres.shape[1]
    reach = int(np.abs(balls.centres).max(initial=0))
    near = [] if first else balls.neighbours()
    out = T.StructType([*rows.select("id", "vector").schema, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from catalith.llm.balls import AT_ONCE, nearest, reassign

        for whole in batches:
            for at in range(0, len(whole), AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                x = np.asarray(batch.column(1).flatten()).reshape(-1, dim)
                if len(x) and dim * (max(int(x.max()), -int(x.min())) + reach) ** 2 >= 1 << 60:
                    raise ValueError("vectors too long for exact distances in 62 bits")
                if first:
                    best, least = nearest(x, balls.centres)
                else:
                    best, least, _ = reassign(x, np.asarray(batch.column(2)).astype(np.int64), balls, near)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.int32()), pa.array(least, pa.int64())], names=out.names)

    return rows.select("id", "vector", "cluster").mapInArrow(run, out)


def _moved(rows: DataFrame, balls: Balls) -> Balls:
    """The balls about the members' exact floored means."""
    dim = balls.centres.shape[1]
    sums = [F.sum(F.get("vector", i)).alias(f"s{i}") for i in range(dim)]
    centres, radii = balls.centres.copy(), [0] * len(balls.centres)  # an empty ball has nothing to compare
    for r in rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"), *sums).collect():  # k rows at most
        i = r["cluster"]
        centres[i] = [r[f"s{c}"] // r["n"] for c in range(dim)]
        way = int(((centres[i] - balls.centres[i]) ** 2).sum())
        radii[i] = math.isqrt(r["far"]) + 1 + (math.isqrt(way) + 1 if way else 0)
    return Balls(centres, tuple(radii))


def ball_kmeans(points: DataFrame, k: int, rounds: int, dim: int, salt: str = "1:", vector: str = "vector", key: str = "vec_id") -> DataFrame:
    """One row for each usable vector of whole numbers: key, cluster, distance (squared), cluster_inertia, inertia, centroid.

    Centroids start as the vectors whose salted ids have the smallest SHA-256. Each round assigns all vectors, then moves the
    centroids of clusters that have members; a last assignment follows."""
    spark = points.sparkSession
    ship(spark)
    kind = points.schema[key].dataType
    rows = points.where(usable(F.col(vector), dim)).select(F.col(key).alias("id"), F.col(vector).cast("array<long>").alias("vector"), F.lit(0).alias("cluster"))
    order = [F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).asc_nulls_last(), F.col("vector")]
    start = [r["vector"] for r in rows.orderBy(*order).limit(k).select("vector").collect()]
    result = T.StructType([T.StructField(key, kind), T.StructField("cluster", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("distance", "cluster_inertia", "inertia")], T.StructField("centroid", T.ArrayType(T.LongType()))])
    if not start:
        return spark.createDataFrame([], result)
    balls = Balls(np.array(start, np.int64), (-1,) * len(start))
    rows, before = written(_pass(rows, balls, first=True))
    for _ in range(rounds):
        balls = _moved(rows, balls)
        rows, path = written(_pass(rows, balls, first=False))
        drop_path(spark, before)
        before = path
    spent = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows at most
    final = spark.createDataFrame([(c, d, sum(spent.values()), balls.centres[c].tolist()) for c, d in spent.items()], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return rows.join(F.broadcast(final), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid")
