"""Streaming variants of the ingest: micro-batches through the same functions as the batch jobs, committed batch by batch.

A micro-batch writes only what it touches, under its own number: new points and the latest values of its keys. Replays write
the same again, and batches that are committed survive a later failure."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from catalith.operators.prices import history, ingest_days
from catalith.session import drop_path, scratch, written
from catalith.sources.store import append, committed, current, level_up

LATEST = "printing_id string, eur decimal(12,2), eur_foil decimal(12,2), updated_at timestamp"
POINTS = "printing_id string, observed_on date, eur decimal(12,2), eur_foil decimal(12,2), source string"
POINT_KEYS = ["printing_id", "observed_on"]
#: Points lie in folders by day, so that a history reads the days it asks for.
POINT_DAYS = ["observed_on"]


def latest_of(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    return current(spark, path, LATEST, ["printing_id"], before=before)


def points_of(spark: SparkSession, path: str) -> DataFrame:
    return current(spark, path, POINTS, POINT_KEYS)


def history_of(spark: SparkSession, path: str, today: Column, retention_days: int = 365, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Stored points as prices.history(); only the folders of its days are read."""
    return history(points_of(spark, path), today, retention_days, start, end)


def apply_prices(batch: DataFrame, number: int, latest_path: str, points_path: str, source: str, fanout: int = 8) -> None:
    """Take in a micro-batch of observations (seq, printing_id, eur, eur_foil, observed_on) of any days, in the order of the days."""
    spark = batch.sparkSession
    batch = batch.persist()
    level_up(spark, latest_path, LATEST, ["printing_id"], before=number, fanout=fanout)
    level_up(spark, points_path, POINTS, POINT_KEYS, before=number, fanout=fanout, by=POINT_DAYS)
    latest, points = ingest_days(batch, latest_of(spark, latest_path, before=number), F.lit(source))
    # points first: they are worked out from the old latest values, so a replay after a failure between the two is harmless
    append(points, points_path, number, POINT_DAYS)
    append(latest, latest_path, number)
    batch.unpersist()


#: Commits of a micro-batch at most; their numbers are the batch's times this, and their own.
MOST_COMMITS = 1_000_000


def lying(rows: DataFrame) -> DataFrame:
    """Rows of a file source with their file and split; for streams this must come before foreachBatch."""
    return rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"))


def row_slices(batch: DataFrame, size: int) -> tuple[DataFrame, int]:
    """(rows of lying() with their slice of `size` rows, number of slices), in an order that a replay repeats: by file, then as they lie in it.

    Rows are numbered within their tasks; only the tasks' counts reach the driver. The rows are staged once, by slice."""
    placed = batch.withColumn("__n", F.monotonically_increasing_id())
    within = Window.partitionBy("__file", "__block").orderBy("__n")
    staged, path = written(placed.withColumn("__n", F.row_number().over(within) - 1))
    counts = staged.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("n")).orderBy("__file", "__block").collect()
    before, rows = 0, []
    for c in counts:
        rows.append((c["__file"], c["__block"], before))
        before += c["n"]
    starts = batch.sparkSession.createDataFrame(rows, "__file string, __block long, __before long")
    slices = staged.join(starts, ["__file", "__block"]).withColumn("__slice", F.floor((F.col("__before") + F.col("__n")) / size))
    sliced = scratch(batch.sparkSession)
    slices.drop("__file", "__block", "__n", "__before").write.partitionBy("__slice").parquet(sliced)
    drop_path(batch.sparkSession, path)
    fields = [x for x in batch.schema.fields if x.name not in ("__file", "__block")]
    schema = T.StructType([*fields, T.StructField("__slice", T.LongType())])
    return batch.sparkSession.read.schema(schema).parquet(sliced), -(-before // size)


def commit_by_rows(batch: DataFrame, number: int, size: int, commit: Callable[[DataFrame, int], None], done: Callable[[int], bool], pause: float = 0.0) -> int:
    """Split a micro-batch of files (see lying()) into commits of `size` rows, one after the other; returns how many were made.

    A commit that fails leaves those before it; a replay skips them (done: whether a number is committed) and goes on. pause: seconds
    between commits."""
    rows, n = row_slices(batch, size)
    if n > MOST_COMMITS:
        raise ValueError(f"more than {MOST_COMMITS} commits in a micro-batch; take larger ones")
    made = 0
    for i in range(n):
        if done(at := number * MOST_COMMITS + i):
            continue
        commit(rows.where(F.col("__slice") == i).drop("__slice"), at)
        made += 1
        if pause and i + 1 < n:
            time.sleep(pause)
    return made


def price_stream(
    spark: SparkSession, landing: str, schema: str, latest_path: str, points_path: str, checkpoint: str, source: str = "stream", files: int = 1, rows: int | None = None, pause: float = 0.0, fanout: int = 8
) -> StreamingQuery:
    """Read all Parquet files of a landing folder that are new, some at a time, and take them in; stops when all are done.

    rows: the most rows of a commit (without it a micro-batch is one); pause: seconds between commits; fanout: see store.level_up()."""

    def take(batch: DataFrame, number: int) -> None:
        if rows is None:
            apply_prices(batch, number, latest_path, points_path, source, fanout)
        else:
            # the latest values are written last, so a commit is done when they are there
            commit_by_rows(batch, number, rows, lambda b, n: apply_prices(b, n, latest_path, points_path, source, fanout), lambda n: committed(spark, latest_path, n), pause)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(landing)
    stream = stream if rows is None else lying(stream)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keyed_stream(spark: SparkSession, landing: str, schema: str, table_path: str, checkpoint: str, files: int = 1, rows: int | None = None) -> StreamingQuery:
    """Append new files of a landing folder batch by batch, of `rows` rows each if given; read the table by store.current()."""

    def take(batch: DataFrame, number: int) -> None:
        if rows is None:
            append(batch, table_path, number)
        else:
            commit_by_rows(batch, number, rows, lambda b, n: append(b, table_path, n), lambda n: committed(spark, table_path, n))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(landing)
    stream = stream if rows is None else lying(stream)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
