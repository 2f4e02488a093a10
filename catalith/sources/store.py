"""Keyed upserts: as a merge of two tables, and as batches appended to a Parquet folder.

A folder of batches has a subfolder for each batch number; writing a number again replaces it, so a replay changes nothing,
and a batch that fails leaves no committed files. Batches are merged by level into runs, whose folders tell the range of
batches they stand for. The current rows are the last of each key. No pointer is kept."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def merge(old: DataFrame, new: DataFrame, keys: list[str], preserve: list[str] | None = None) -> DataFrame:
    """old with the rows of new by key; preserved columns keep their old value where new has none (or lacks the column)."""
    kept = set(preserve or [])
    joined = old.alias("o").join(new.alias("n"), keys, "full_outer")
    came = F.coalesce(F.col("n.__new"), F.lit(False)) if "__new" in new.columns else None
    cols = []
    for c in old.columns:
        if c in keys:
            cols.append(F.col(c))
        elif c not in new.columns:
            cols.append(F.col(f"o.{c}").alias(c))
        elif c in kept:
            cols.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c))
        else:
            cols.append(F.when(came, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*cols)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], preserve: list[str] | None = None) -> DataFrame:
    return merge(old, new.withColumn("__new", F.lit(True)), keys, preserve)


def upsert_counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """total, added, updated of an upsert."""
    seen = new.select(*keys).distinct().join(old.select(*keys, F.lit(True).alias("has")), keys, "left")
    return seen.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("has").isNull()).alias("added"), F.count_if(F.col("has")).alias("updated"))


def sync_counts(old: DataFrame, plan: DataFrame, icons: int = 0) -> DataFrame:
    """total, added, updated, images and hashes of a sync. plan: see catalogue.image_plan(); icons: set icons stored besides."""
    work = plan.agg(F.coalesce(F.sum(F.size("uploads")), F.lit(0)).alias("images"), F.coalesce(F.sum("hashes"), F.lit(0)).alias("hashes"))
    return upsert_counts(old, plan, ["id"]).crossJoin(work).withColumn("images", F.col("images") + F.lit(icons))  # one row each


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path, as the JVM has them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def append(df: DataFrame, path: str, batch: int, by: list[str] | None = None) -> None:
    """Write a batch, in folders by the columns of `by`; a replay of the same number replaces it."""
    df.write.mode("overwrite").partitionBy(*(by or [])).parquet(f"{path}/batch={batch}")


def committed(spark: SparkSession, path: str, batch: int) -> bool:
    """Whether a batch was written to its end."""
    fs, where = _files(spark, f"{path}/batch={batch}/_SUCCESS")
    return fs.exists(where)


class Run(NamedTuple):
    """A folder with the batches first to last: one batch of level 0, or several merged into their last rows."""

    first: int
    last: int
    level: int
    folder: str


def runs(spark: SparkSession, path: str) -> tuple[list[Run], list[Run]]:
    """(live runs by their order, superseded ones). A merged run supersedes all that lie in its range; unfinished folders do not count."""
    fs, where = _files(spark, path)
    found = []
    for status in fs.listStatus(where) if fs.exists(where) else []:
        name = status.getPath().getName()
        if not fs.exists(_files(spark, f"{path}/{name}/_SUCCESS")[1]):
            continue
        if name.startswith("batch="):
            n = int(name[6:])
            found.append(Run(n, n, 0, name))
        elif name.startswith("merged="):
            level, first, last = map(int, name[7:].split("_"))
            found.append(Run(first, last, level, name))
    found.sort(key=lambda r: (r.first, -r.last, -r.level))
    live: list[Run] = []
    for r in found:
        if not live or r.last > live[-1].last:
            live.append(r)
    return live, [r for r in found if r not in live]


def batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all live runs with their batch number; none before the first batch. Merged runs have each key's last row only."""
    kind = T.StructType.fromDDL(schema)
    full = T.StructType([*kind.fields, T.StructField("batch", T.LongType())])
    live, _ = runs(spark, path)
    out = spark.createDataFrame([], full)
    for folders in ([r.folder for r in live if not r.level], [r.folder for r in live if r.level]):
        if folders:
            out = out.unionByName(spark.read.schema(full).option("basePath", path).parquet(*[f"{path}/{f}" for f in folders]).select(*full.names))
    return out


def last_rows(rows: DataFrame, schema: str, keys: list[str], preserve: list[str] | None = None) -> DataFrame:
    """The last row of each key by batch, with that batch; preserved columns have their last value that is not null."""
    kept = set(preserve or [])
    values = [c for c in rows.columns if c not in keys and c != "batch" and c not in kept]
    aggs = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("batch"))).alias(c) for c in kept]
    if values:
        aggs.append(F.max_by(F.struct(*values), "batch").alias("__last"))
    out = rows.groupBy(*keys).agg(*aggs, F.max("batch").alias("batch"))
    pick = {c: F.col(f"__last.{c}").alias(c) for c in values}
    return out.select(*[pick.get(c, F.col(c)) for c in T.StructType.fromDDL(schema).names], "batch")


def current(spark: SparkSession, path: str, schema: str, keys: list[str], preserve: list[str] | None = None, before: int | None = None) -> DataFrame:
    """The last row of each key over all batches (before a number); preserved columns have their last value that is not null."""
    rows = batches(spark, path, schema)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    return last_rows(rows, schema, keys, preserve).drop("batch")


def level_up(spark: SparkSession, path: str, schema: str, keys: list[str], preserve: list[str] | None = None, before: int | None = None, fanout: int = 8, by: list[str] | None = None) -> int:
    """Merge runs by level until none has `fanout` neighbours of its level: a batch is merged once a level, and what is read
    for the current rows is `fanout` runs a level at most, instead of all batches there ever were. Only batches before a number
    are merged, so that a replay of that batch still finds the state before it. Folders that a merge supersedes stay for readers until
    the next call. by: as in append(). Returns the number of merges."""
    fs, _ = _files(spark, path)
    for old in runs(spark, path)[1]:
        fs.delete(_files(spark, f"{path}/{old.folder}")[1], True)
    made = 0
    while True:
        live = [r for r in runs(spark, path)[0] if before is None or r.last < before]
        group = next((live[i : i + fanout] for i in range(len(live) - fanout + 1) if len({r.level for r in live[i : i + fanout]}) == 1), None)
        if not group:
            return made
        full = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("batch", T.LongType())])
        rows = spark.read.schema(full).option("basePath", path).parquet(*[f"{path}/{r.folder}" for r in group]).select(*full.names)
        last_rows(rows, schema, keys, preserve).write.mode("overwrite").partitionBy(*(by or [])).parquet(f"{path}/merged={group[0].level + 1}_{group[0].first}_{group[-1].last}")
        made += 1


def compacted(spark: SparkSession, path: str, to: str, schema: str, keys: list[str], preserve: list[str] | None = None) -> None:
    """The current rows as batch 0 of a new folder."""
    append(current(spark, path, schema, keys, preserve), to, 0)


def quarantined(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass all checks, the others with the names of the failed ones in `errors`). A null check has failed."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    marked = rows.withColumn("errors", failed)
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


def reported(run: Callable[[], dict]) -> dict:
    """The counters of a run, or a report that it failed; what it has committed before stays."""
    try:
        return {"status": "completed", **run()}
    except Exception as e:  # a failed run is a result, not an error of the caller
        return {"status": "failed", "error": f"{type(e).__name__}: {e}"}


LEDGER = "attempts int, error string, failed boolean"


def ledger(spark: SparkSession, path: str, keys: str) -> DataFrame:
    """The rows that failed and have not succeeded since: keys, attempts so far, the last error. keys: columns with types."""
    names = T.StructType.fromDDL(keys).names
    return current(spark, path, f"{keys}, {LEDGER}", names).where("failed").drop("failed")


def work_list(pending: DataFrame, failed: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """pending with the attempts so far, without rows that failed `most` times, those tried least first when taken in order."""
    todo = pending.join(failed.select(*keys, "attempts"), keys, "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    return todo if most is None else todo.where(F.col("attempts") < most)


def settle(spark: SparkSession, results: DataFrame, path: str, keys: str, run: int) -> None:
    """Write the outcome of a run into the ledger: results are work_list() rows with error (null if it went well). A replay of the
    run replaces its outcome; rows that went well and had never failed leave no trace."""
    names = T.StructType.fromDDL(keys).names
    rows = results.where(F.col("error").isNotNull() | (F.col("attempts") > 0))
    append(rows.select(*names, (F.col("attempts") + F.col("error").isNotNull().cast("int")).alias("attempts"), "error", F.col("error").isNotNull().alias("failed")), path, run)


def rebuild_index(rows: DataFrame, path: str, run: int) -> None:
    """Write an index as a new run. One that fails leaves no committed files, and the run before stays live."""
    rows.write.mode("overwrite").parquet(f"{path}/run={run}")


def live_index(spark: SparkSession, path: str) -> DataFrame:
    """The index of the last run that was committed."""
    every = spark.read.parquet(path)
    last = every.agg(F.max("run")).first()[0]
    return every.where(F.col("run") == last).drop("run")
