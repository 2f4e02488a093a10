"""Operator 3: line dedup with levelled sorted runs of line hashes. DataFrame functions only.

Documents come in batches, more of them than `fanout`, so that later ones look at compacted runs. Every batch merge-anti-joins the runs so far: line keys that no run holds form the batch's own
run (level 0), sorted by hash and bucketed, with the number of documents and the largest document id of each key. Keys
that a run does hold go to a second, much smaller family of runs, the repeats. When a family has `fanout` runs of one
level they are merged into one run of the next level. So a key is in one first-seen run at most, and only keys that come
again cost more than one look. A key's total is its first-seen count plus its repeats.

Defined results: null or empty text is one empty line. Rows that repeat a doc_id are one document in the counts and keep a
result each; decisions hold for all of them. A tie cannot occur: the keeper is the largest doc_id. Rows with a null doc_id
keep all their lines and are not counted. Lines and texts may be of any length: the work grows with
a text's lines times the logarithm of those it loses. An empty table gives an empty table. All
columns stay, but for text, n_lines and n_dropped, which are replaced where the input has them.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.session import drop_path, scratch, unused, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]
LEAST_BUCKETS, BUCKET_KEYS = 8, 1_000_000
BATCHES, FANOUT = 5, 3


def line_key(line: Column) -> Column:
    """The line without white space at its ends, ASCII letters in lower case."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), UPPER, LOWER)


def key_hash(line: Column) -> Column:
    """128 bits of a line's key; null for keys that are too short to matter is up to the caller."""
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each distinct eligible line key of each row of docs: key, h1, h2.

    Keys are made distinct as strings, which Spark does by a hash set; structs it would compare pair by pair."""
    keys = F.filter(F.transform(lines_of(F.col(text)), line_key), lambda k: F.char_length(k) >= min_chars)
    hashes = F.explode(F.transform(F.array_distinct(keys), key_hash))
    return docs.where(F.col(key).isNotNull()).select(key, hashes.alias("h")).select(key, "h.h1", "h.h2")


def without_lost(lines: Column, lost: Column, min_chars: int) -> Column:
    """Lines whose hashes are not in the sorted array lost, by a binary search for each: steps of falling powers of two."""
    hashes = F.transform(lines, lambda x: F.when(F.char_length(line_key(x)) >= min_chars, key_hash(line_key(x))))
    steps = F.transform(F.sequence(F.length(F.bin(F.size(lost))), F.lit(0), F.lit(-1)), lambda b: F.pow(F.lit(2), b).cast("int"))
    place = lambda h: F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(lost, at + step) <= h, at + step).otherwise(at))
    gone = F.transform(hashes, lambda h: F.coalesce(F.get(lost, place(h)) == h, F.lit(False)))
    # zipped, so that the flags are worked out once and not within the filter's function
    kept = F.filter(F.arrays_zip(lines.alias("line"), gone.alias("gone")), lambda p: ~p["gone"])
    return F.transform(kept, lambda p: p["line"])


class LineRuns:
    """Runs of (h1, h2, n, top) in levels, as bucketed sorted tables in the shared folder."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.made = 0
        self.levels: dict[str, list[list[tuple[str, str]]]] = {"first": [], "again": []}

    def _save(self, df: DataFrame) -> tuple[str, str]:
        table, path = f"{self.name}_{self.made}", scratch(self.spark)
        self.made += 1
        # a task for each bucket, so that a run is one sorted file a bucket
        dealt = df.repartition(self.buckets, F.pmod(F.hash(*KEY), F.lit(self.buckets)))
        (dealt.write.format("parquet").option("path", path).bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(table))
        return table, path

    def _drop(self, run: tuple[str, str]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run[0]}")
        drop_path(self.spark, run[1])

    def runs(self, family: str) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels[family] for t, _ in level]

    def _push(self, family: str, run: tuple[str, str], level: int = 0) -> None:
        levels = self.levels[family]
        if len(levels) == level:
            levels.append([])
        levels[level].append(run)
        if len(levels[level]) >= self.fanout:
            old, levels[level] = levels[level], []
            merged = self.spark.table(old[0][0])
            for t, _ in old[1:]:
                merged = merged.unionByName(self.spark.table(t))
            self._push(family, self._save(merged.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("top").alias("top"))), level + 1)
            for x in old:
                self._drop(x)

    def add(self, keys: DataFrame, key: str = "doc_id") -> None:
        """Take in a batch of line_hashes()."""
        mine, path = written(keys.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("top")))
        fresh, seen = mine, []
        for run in self.runs("first"):
            fresh = fresh.join(run, KEY, "left_anti")
            seen.append(mine.join(run, KEY, "left_semi"))
        first = self._save(fresh)
        if seen:
            again = seen[0]
            for x in seen[1:]:
                again = again.unionByName(x)  # a key is in one of the first-seen runs at most
            self._push("again", self._save(again))
        self._push("first", first)
        drop_path(self.spark, path)

    def repeated(self, min_docs: int) -> DataFrame:
        """Keys found in at least min_docs rows and the largest document id that holds each."""
        first = again = None
        for run in self.runs("first"):
            first = run if first is None else first.unionByName(run)
        for run in self.runs("again"):
            again = run if again is None else again.unionByName(run)
        if again is None:
            return first.where(F.col("n") >= min_docs).select(*KEY, "top")
        more = again.groupBy(*KEY).agg(F.sum("n").alias("m"), F.max("top").alias("upper"))
        total = first.join(more, KEY, "left").withColumn("n", F.col("n") + F.coalesce("m", F.lit(0)))
        return total.where(F.col("n") >= min_docs).select(*KEY, F.greatest("top", "upper").alias("top"))

    def close(self) -> None:
        for levels in self.levels.values():
            for level in levels:
                for run in level:
                    self._drop(run)
        self.levels = {"first": [], "again": []}


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = BATCHES, buckets: int | None = None, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """docs with the text less its repeated lines, and n_lines (before), n_dropped.

    Three passes over the input: keys into the runs, keys against the repeated ones, texts against their own list of lost
    lines. Only hashes are shuffled in the first two; the last is a join on doc_id that shuffles the texts once."""
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")])
    ident, lost_, lines_, kept_ = unused([*docs.columns, "n_lines", "n_dropped"], "id", "lost", "lines", "kept")
    keys, keys_at = written(line_hashes(docs, min_chars, text, key).select(F.col(key).alias("id"), *KEY, F.pmod(F.xxhash64(key), F.lit(batches)).alias("batch")))
    runs = LineRuns(spark, buckets or max(LEAST_BUCKETS, math.ceil(keys.count() / BUCKET_KEYS)))
    for b in range(batches):
        runs.add(keys.where(F.col("batch") == b).drop("batch"), "id")
    repeated, repeated_at = written(runs.repeated(min_docs))
    runs.close()
    # merge joins at every size: none of the sides has a proven bound, and hot keys are split by AQE
    hits, hits_at = written(keys.select("id", *KEY).join(repeated.hint("merge"), KEY))
    # rows that repeat a doc_id are one document
    shared, shared_at = written(hits.select("id", *KEY).distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select(*KEY))
    lost = hits.where(F.col("id") < F.col("top")).join(shared.hint("merge"), KEY, "left_semi")
    lost, _ = written(lost.groupBy(F.col("id").alias(ident)).agg(F.sort_array(F.collect_set(F.struct(*KEY))).alias(lost_)))
    for p in (keys_at, repeated_at, hits_at, shared_at):
        drop_path(spark, p)
    joined = docs.join(lost.hint("merge"), F.col(key) == F.col(ident), "left").withColumn(lines_, lines_of(F.col(text)))
    joined = joined.withColumn(kept_, F.when(F.col(lost_).isNull(), F.col(lines_)).otherwise(without_lost(F.col(lines_), F.col(lost_), min_chars)))
    out = {text: F.array_join(kept_, "\n"), "n_lines": F.size(lines_).cast("long"), "n_dropped": (F.size(lines_) - F.size(kept_)).cast("long")}
    return joined.withColumns(out).drop(ident, lost_, lines_, kept_)
