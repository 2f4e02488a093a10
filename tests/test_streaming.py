import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from catalith.operators import prices
from catalith.sources import store
from catalith.streaming.ingest import MOST_COMMITS, apply_prices, commit_by_rows, keyed_stream, latest_of, lying, points_of, price_stream

LATEST = "printing_id string, eur decimal(12,2), eur_foil decimal(12,2), updated_at timestamp"
POINTS = "printing_id string, observed_on date, eur decimal(12,2), eur_foil decimal(12,2), source string"
POINTS_COLUMNS = ["printing_id", "observed_on", "eur", "eur_foil", "source"]
SCHEMA = "seq long, printing_id string, eur decimal(12,2), eur_foil decimal(12,2), observed_on date"


def test_stream_equals_batch_and_replay_is_harmless(spark, tmp_path):
    day = lambda d: dt.date(2026, 6, d)
    values = [(1, "a", "1.50", day(1)), (2, "a", "1.75", day(1)), (3, "b", None, day(1)), (4, "a", "1.75", day(2)), (5, "b", "2.00", day(3)), (6, "a", None, day(3)), (7, "b", "2.00", day(4))]
    rows = [(s, p, v and Decimal(v), None, d) for s, p, v, d in values]
    for d in (1, 2, 3, 4):
        spark.createDataFrame([r for r in rows if r[4] == day(d)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))
    paths = [str(tmp_path / x) for x in ("latest", "points")]
    for checkpoint in ("one", "one", "two"):  # the second run finds nothing new, the third reads all again
        price_stream(spark, str(tmp_path / "landing"), SCHEMA, *paths, str(tmp_path / checkpoint), files=100).awaitTermination()
        if checkpoint == "one":
            got = sorted((r["printing_id"], str(r["observed_on"]), r["eur"]) for r in points_of(spark, paths[1]).collect())
    want = prices.points_of(spark.createDataFrame(rows, SCHEMA), "printing_id", "observed_on", "seq", ["eur", "eur_foil"])
    assert got == sorted((r["printing_id"], str(r["observed_on"]), r["eur"]) for r in want.collect())
    assert {r["printing_id"]: r["eur"] for r in latest_of(spark, paths[0]).collect()} == {"a": None, "b": Decimal("2.00")}


def test_days_at_once_equal_days_one_by_one(spark, tmp_path):
    """Micro-batches of several days against ingest_batch() for each day; a later batch of the same day overwrites its point."""
    rng, row = random.Random(1), 0
    latest, points = spark.createDataFrame([], LATEST), spark.createDataFrame([], POINTS)
    for number, days in enumerate([(1, 2, 3), (3, 4), (4,), (5, 7)]):
        rows = []
        for d in days:
            for _ in range(rng.randint(3, 8)):
                row += 1
                rows.append((row, rng.choice("abcd"), rng.choice([None, Decimal("1.00"), Decimal("2.00")]), rng.choice([None, Decimal("3.00")]), dt.date(2026, 6, d)))
        batch = spark.createDataFrame(rows, SCHEMA)
        for d in days:
            one = batch.where(F.col("observed_on") == dt.date(2026, 6, d))
            latest, points, _ = prices.ingest_batch(one, latest, points, F.lit(dt.date(2026, 6, d)), F.lit("stream"), F.lit(dt.date(2026, 6, d)))
            latest, points = (spark.createDataFrame(x.collect(), x.schema) for x in (latest, points))
        for _ in range(2):  # a replay changes nothing
            apply_prices(batch, number, str(tmp_path / "l"), str(tmp_path / "p"), "stream")
    assert sorted(map(str, points_of(spark, str(tmp_path / "p")).collect())) == sorted(map(str, points.select(*POINTS_COLUMNS).collect()))
    assert sorted(map(str, latest_of(spark, str(tmp_path / "l")).collect())) == sorted(map(str, latest.collect()))


def test_keyed_stream(spark, tmp_path):
    schema = "id int, name string, image string"
    spark.createDataFrame([(1, "a", "x"), (2, "b", None)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    table = str(tmp_path / "t")
    run = lambda: keyed_stream(spark, str(tmp_path / "in"), schema, table, str(tmp_path / "c")).awaitTermination()
    rows = lambda path: sorted(map(tuple, store.current(spark, path, schema, ["id"], ["image"]).collect()))
    assert rows(table) == []
    run()
    spark.createDataFrame([(1, "A", None)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert rows(table) == [(1, "A", "x"), (2, "b", None)]
    store.compacted(spark, table, str(tmp_path / "small"), schema, ["id"], ["image"])
    assert rows(str(tmp_path / "small")) == rows(table)


TABLE = "id int, name string, image string"


def test_levels_keep_what_is_read_small(spark, tmp_path):
    """After each batch the live runs hold few rows, however many batches there were; the current rows are those of all batches."""
    rng, path, history, plain = random.Random(2), str(tmp_path / "t"), 0, {}
    for number in range(14):
        rows = [(i, f"{number}", rng.choice([None, f"i{number}"])) for i in rng.sample(range(12), 10)]
        history += len(rows)
        for i, name, image in rows:
            plain[i] = (name, image or plain.get(i, ("", None))[1])
        store.level_up(spark, path, TABLE, ["id"], ["image"], before=number, fanout=3)
        store.append(spark.createDataFrame(rows, TABLE).coalesce(1), path, number)
        live, _ = store.runs(spark, path)
        assert all(sum(r.level == level for r in live) <= 3 for level in range(4))
    assert {r["id"]: (r["name"], r["image"]) for r in store.current(spark, path, TABLE, ["id"], ["image"]).collect()} == plain
    assert store.batches(spark, path, TABLE).count() <= 5 * 12 < history == 140
    # a replay of the last batch sees the state before it
    assert store.current(spark, path, TABLE, ["id"], before=13).where("name = '13'").count() == 0
    # a merge that was not finished does not count
    (tmp_path / "t/merged=9_0_13").mkdir()
    assert store.batches(spark, path, TABLE).count() > 0


def landed(spark, tmp_path, n, files=2):
    for f in range(files):
        spark.createDataFrame([(i, f"n{i}", None) for i in range(f * n // files, (f + 1) * n // files)], TABLE).coalesce(1).write.parquet(str(tmp_path / f"in/{f}"))
    return lying(spark.read.schema(TABLE).parquet(*[str(tmp_path / f"in/{f}") for f in range(files)]))


def test_a_third_commit_that_fails_leaves_two(spark, tmp_path):
    batch, path = landed(spark, tmp_path, 23), str(tmp_path / "t")
    broken = True

    def commit(rows, number):
        if broken and number == 5 * MOST_COMMITS + 2:
            raise OSError("lost")
        store.append(rows, path, number)

    done = lambda n: store.committed(spark, path, n)
    report = store.reported(lambda: {"made": commit_by_rows(batch, 5, 5, commit, done)})
    assert report["status"] == "failed" and store.batches(spark, path, TABLE).count() == 10
    broken = False
    assert commit_by_rows(batch, 5, 5, commit, done) == 3  # those that are there are not made again
    rows = store.batches(spark, path, TABLE)
    assert sorted(r["id"] for r in rows.collect()) == list(range(23))
    assert sorted(r["count"] for r in rows.groupBy("batch").count().collect()) == [3, 5, 5, 5, 5]


def test_streams_commit_by_rows(spark, tmp_path):
    landed(spark, tmp_path, 23, files=1)
    keyed_stream(spark, str(tmp_path / "in/*"), TABLE, str(tmp_path / "t"), str(tmp_path / "c"), rows=10).awaitTermination()
    assert sorted(r["count"] for r in store.batches(spark, str(tmp_path / "t"), TABLE).groupBy("batch").count().collect()) == [3, 10, 10]
