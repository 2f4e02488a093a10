import numpy as np
import pytest
from pyspark.sql import functions as F

from catalith.llm import search

NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")


def vectors(n, d, seed, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[n - copies :] = x[0]
    return x


def brute(ids, x, score, k, is_query):
    out = []
    for q in ids:
        if is_query(q):
            s = [(score(x[ids.index(q)], x[j]), i) for j, i in enumerate(ids) if i != q]
            out += [(q, r + 1, i, -v) for r, (v, i) in enumerate(sorted((-v, i) for v, i in s)[:k])]
    return sorted(out)


@pytest.mark.parametrize("copies", [0, 150])
def test_nearest_equals_brute_force(spark, copies):
    x = vectors(400, 16, 1, copies)
    ids = list(range(400))
    df = table(spark, [(i, x[i].tolist(), 7) for i in ids]).repartition(5)
    got = search.nearest(df, F.col("vec_id") % 20 == 0, k=10).collect()
    d = x.astype(float)
    want = brute(ids, d, lambda a, b: -np.sqrt(((a - b) ** 2).sum()), 10, lambda q: q % 20 == 0)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [w[:3] for w in want]
    assert all(abs(r["score"] + w[3]) < 1e-12 for r, w in zip(sorted(got, key=lambda r: (r["query_id"], r["rank"])), want, strict=True))


def test_nearest_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, None, 1), (2, [0.0, 0.0], 1), (3, [NAN, 1.0], 1), (4, [None, 1.0], 1), (5, [INF, 1.0], 1), (6, [1.0, 1.0], 1), (6, [1.0, 0.5], 1), (None, [1.0, 0.0], 1), (7, [1.0, 0.0, 0.0], 1), (8, [], 1), (9, [-1.0, 0.0], 1)]
    got = search.nearest(table(spark, rows), F.col("vec_id") == 0, k=3).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 6, 0.5), (2, 9, 2.0)]
    assert search.nearest(table(spark, []), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("copies", [0, 150])
def test_products_equal_brute_force(spark, copies):
    x = np.floor(256 * vectors(400, 12, 3, copies).astype(float)).astype(np.int64)
    ids = list(range(400))
    df = spark.createDataFrame([(i, x[i].tolist()) for i in ids], "vec_id long, vector array<long>").repartition(3)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in search.largest_products(df, F.col("vec_id") % 50 == 0).collect())
    assert got == brute(ids, x, lambda a, b: int((a * b).sum()), 5, lambda q: q % 50 == 0)


def test_products_with_lengths_far_apart_leave_short_bands_out(spark, monkeypatch):
    """Long vectors decide all queries; ties, repeated ids and other columns of any name change nothing."""
    monkeypatch.setattr(search, "TILE_POINTS", 40)
    monkeypatch.setattr(search, "TILE_QUERIES", 7)
    rng = np.random.default_rng(9)
    x = np.rint(rng.normal(size=(500, 6)) * np.exp(rng.normal(size=(500, 1)) * 2) * 100).astype(np.int64)
    x[300:350] = x[10]
    rows = [(i, x[i].tolist(), 1, 2) for i in range(500)] + [(3, x[3].tolist(), 5, 5)] * 3
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>, least int, qb int").repartition(4)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in search.largest_products(df, F.col("vec_id") % 20 == 0).collect())
    assert got == brute(list(range(500)), x, lambda a, b: int((a * b).sum()), 5, lambda q: q % 20 == 0)


def test_products_odd_rows(spark):
    df = spark.createDataFrame([(0, [3, 4]), (1, None), (2, [None, 1]), (3, [0, 0]), (4, [2**40, 2**40]), (4, [1, 1]), (5, [1, 2, 3]), (6, [-3, -4])], "vec_id long, vector array<long>")
    got = search.largest_products(df, F.col("vec_id") == 0, k=9).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(4, 7 * 2**40), (3, 0), (6, -25)]
    assert search.largest_products(df.limit(0), F.col("vec_id") == 0).count() == 0
    long = spark.createDataFrame([(i, [i] * 20_000) for i in range(4)], "vec_id long, vector array<long>")
    got = search.largest_products(long, F.col("vec_id") == 1, k=2).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(3, 60_000), (2, 40_000)]


def test_bounds_hold():
    x, y = vectors(50, 8, 5).astype(float), vectors(60, 8, 6).astype(float)
    (a, s, e), (b, t, f) = search.quantised(x), search.quantised(y)
    near = np.sqrt(np.maximum(((a * s[:, None]) ** 2).sum(1)[:, None] + ((b * t[:, None]) ** 2).sum(1)[None] - 2 * s[:, None] * t[None] * search.int8_products(a, b), 0))
    true = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    assert (np.abs(near - true) <= e[:, None] + f[None] + 1e-6).all()
