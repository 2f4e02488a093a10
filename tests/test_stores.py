"""Histograms and sketches, the retry ledger, points by day and saved hash indexes."""

import datetime as dt
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalith.operators import hamming, scanlog
from catalith.sources import store
from catalith.streaming import ingest

INF = float("inf")


def test_histograms_merge_and_leave_out_what_is_no_number(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([None, float("nan"), 5.0, 5.1, rng.uniform(-10, 200)])) for _ in range(500)]
    df = spark.createDataFrame(rows, "tag string, v double").repartition(3)
    whole = {(r["tag"], r["bucket"]): tuple(r[2:]) for r in scanlog.histogram(df, ["tag"], "v", (5, 50)).collect()}
    halves = [scanlog.histogram(spark.createDataFrame(rows[i::2], df.schema), ["tag"], "v", (50, 5)) for i in (0, 1)]
    merged = {(r["tag"], r["bucket"]): tuple(r[2:]) for r in scanlog.merged_histograms(halves[0].unionByName(halves[1]), ["tag"]).collect()}
    for tag in "ab":
        for low, bucket in ((-INF, 5.0), (5.0, 50.0), (50.0, INF)):
            mine = [v for t, v in rows if t == tag and v is not None and low < v <= bucket]
            for got in (whole, merged):
                n, total, least, most = got[tag, bucket]
                assert (n, least, most) == (len(mine), min(mine), max(mine)) and total == pytest.approx(sum(mine))
    assert scanlog.histogram(df.where("v is null"), ["tag"], "v").count() == 0


def test_quantiles_of_histograms_and_sketches(spark):
    values = list(range(1, 1001))
    df = spark.createDataFrame([("t", float(v)) for v in values], "tag string, v double")
    h = scanlog.histogram(df, ["tag"], "v", tuple(range(100, 1000, 100)))
    for share in (0.0, 0.25, 0.5, 0.999, 1.0):
        assert scanlog.histogram_quantiles(h, ["tag"], share).first()["quantile"] == pytest.approx(1000 * share, abs=2)
    parts = [scanlog.quantile_sketches(df.where(f"v % 2 = {i}"), ["tag"], "v") for i in (0, 1)]
    got = scanlog.sketch_quantiles(scanlog.merged_sketches(parts[0].unionByName(parts[1]), ["tag"]), ["tag"], [0.5, 0.9]).first()
    assert got["records"] == 1000 and got["p50"] == pytest.approx(500, abs=25) and got["p90"] == pytest.approx(900, abs=25)


def test_histograms_of_a_stream_by_window(spark, tmp_path):
    at = lambda m: dt.datetime(2026, 1, 1, 0, m)
    rows = [(at(m), float(m)) for m in range(60)]
    spark.createDataFrame(rows, "at timestamp, v double").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("at", "2 hours")
    out = scanlog.histogram(stream, [F.window("at", "30 minutes").alias("w")], "v", (10, 40))
    out.writeStream.format("memory").queryName("hist").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {(r["w"]["start"].minute, r["bucket"]): r["records"] for r in spark.table("hist").collect()}
    assert got == {(0, 10.0): 11, (0, 40.0): 19, (30, 40.0): 11, (30, INF): 19}


def test_ledger_counts_attempts_until_success(spark, tmp_path):
    path, keys = str(tmp_path / "ledger"), "id long"
    pending = spark.createDataFrame([(1,), (2,), (3,), (4,)], keys)
    rows = lambda df: {r["id"]: (r["attempts"], r["error"]) for r in df.collect()}
    assert rows(store.ledger(spark, path, keys)) == {}

    def run(number, failing, most=None):
        todo = store.work_list(pending, store.ledger(spark, path, keys), ["id"], most)
        ids = sorted(r["id"] for r in todo.collect())
        store.settle(spark, todo.withColumn("error", F.when(F.col("id").isin(*failing), F.lit(f"run {number}"))), path, keys, number)
        return ids

    assert run(0, [1, 2]) == [1, 2, 3, 4] and rows(store.ledger(spark, path, keys)) == {1: (1, "run 0"), 2: (1, "run 0")}
    run(1, [2])
    run(2, [2, 4])
    assert rows(store.ledger(spark, path, keys)) == {2: (3, "run 2"), 4: (1, "run 2")}
    assert run(3, [4], most=3) == [1, 3, 4]  # given up
    assert rows(store.ledger(spark, path, keys)) == {2: (3, "run 2"), 4: (2, "run 3")}


def test_a_history_reads_its_days_only(spark, tmp_path):
    path, day = str(tmp_path / "points"), lambda d: dt.date(2026, 6, d)
    rows = [(f"p{i}", day(d), Decimal(d), None, "s") for d in range(1, 21) for i in range(3)]
    for number in range(4):
        batch = [r for r in rows if r[1].day % 4 == number]
        store.append(spark.createDataFrame(batch, ingest.POINTS), path, number, ingest.POINT_DAYS)
    store.level_up(spark, path, ingest.POINTS, ingest.POINT_KEYS, fanout=3, by=ingest.POINT_DAYS)
    found = ingest.history_of(spark, path, F.lit(day(20)), 15, F.lit(day(8)), F.lit(day(9)))
    assert sorted((r["printing_id"], r["observed_on"]) for r in found.collect()) == [(f"p{i}", day(d)) for i in range(3) for d in (8, 9)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(observed_on") >= 1
    read = store.batches(spark, path, ingest.POINTS).where((F.col("observed_on") >= day(8)) & (F.col("observed_on") <= day(9)))
    assert {f.rsplit("observed_on=", 1)[1][:10] for f in (r[0] for r in read.select(F.input_file_name()).distinct().collect())} == {"2026-06-08", "2026-06-09"}


@pytest.mark.parametrize(("radius", "k"), [(20, 3), (20, None), (2, None), (2, 2)])
def test_saved_index_equals_brute_force_and_is_not_shuffled(spark, tmp_path, monkeypatch, radius, k):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 62, 40)
    hashes = [int(base[i % 40]) ^ int(sum(1 << int(b) for b in set(rng.integers(0, 62, i % 5)))) for i in range(200)]
    index = spark.createDataFrame(list(enumerate(hashes)), "id long, hash long")
    queries = index.where("id % 7 = 0")
    saved = hamming.save_index(index, f"index_{radius}_{k}", str(tmp_path / "index"), radius=2, blocks=6)
    monkeypatch.setattr(hamming, "TILE_QUERIES", 15)
    want = sorted((q, i, (hashes[q] ^ h).bit_count()) for q in range(0, 200, 7) for i, h in enumerate(hashes) if (hashes[q] ^ h).bit_count() <= radius)
    if k:
        want = sorted(r for q in range(0, 200, 7) for r in sorted((x for x in want if x[0] == q), key=lambda x: (x[2], x[1]))[:k])
    found = hamming.search_saved(queries, saved, radius, k)
    assert sorted((r["query_id"], r["id"], r["distance"]) for r in found.collect()) == want
    monkeypatch.setattr(hamming, "TILE_QUERIES", 16_384)
    plan = hamming.search_saved(queries, saved, radius)._jdf.queryExecution().executedPlan().toString()
    below = plan[: plan.index(f"index_{radius}_{str(k).lower()}")].splitlines()[-3:]
    assert not any("Exchange" in line for line in below), plan
    hamming.drop_index(spark, saved)
    with pytest.raises(ValueError, match="too short"):
        hamming.save_index(index, "no", str(tmp_path / "no"), radius=30)
