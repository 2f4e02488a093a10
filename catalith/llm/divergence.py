"""Operator 12: source divergence audit with DuckDB shards.

1. Every task counts the terms of its own documents in DuckDB, so that what is shuffled is (lang, source, term) counts.
2. Counts go to shards by a hash of lang and term; a shard sums them in SQL and keeps the terms that enough documents of the
   lang hold. Spark adds the totals of each group and the number of terms of each lang.
3. The kept counts and the totals go to shards by lang and term again. A shard gives, in SQL, partial sums of
   abs(p - q) for each pair of sources of a lang, and its own leading terms of each group. Spark merges sums and rankings.

A hot source, lang or term is spread: counts are combined before each shuffle, and a lang's terms lie in many shards. In a
shard only what counts hold is paired: for each pair the terms that neither source holds differ by the same amount, so they enter
as their number times that amount. Totals (a row a group) are dealt to the shards, not broadcast.

Defined results: null text, lang or source is ''. Every row of docs is a document, repeated ones too. A text without terms
still makes its group. A lang whose terms are all rare has no terms, and its pairs the value 0. Ties are ordered by the item's
UTF-8 bytes. Texts may be of any length. An empty table gives an empty table. Only lang, source and text are read, so other
columns cannot clash. Counts are exact to 63 bits, products to 127.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalith.llm.bpe import parts
from catalith.session import drop_path, ship, written

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows of counts that a task holds before it combines them or gives them on.
HELD = 1_000_000
#: Kept counts of a shard, about.
SHARD_ROWS = 250_000
COUNTS = "lang string, source string, term string, n long, docs long"


def _database():
    """A DuckDB connection of one thread that keeps to memory."""
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "preserve_insertion_order": False})
    con.execute("SET enable_progress_bar = false")
    return con


class Counts:
    """Sums of (lang, source, term) in DuckDB; holds HELD rows at most unless all of them differ and must stay together."""

    def __init__(self, con, most: int | None = None):
        self.con, self.most, self.rows = con, most or HELD, 0
        con.execute("CREATE TABLE held (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")

    def add(self, sql: str, batch: pa.RecordBatch) -> None:
        self.con.register("batch", pa.Table.from_batches([batch]))
        self.rows += self.con.execute(f"INSERT INTO held {sql}").fetchall()[0][0]
        self.con.unregister("batch")

    @property
    def full(self) -> bool:
        return self.rows > self.most

    def combine(self) -> None:
        self.con.execute("CREATE TABLE summed AS SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM held GROUP BY ALL")
        self.con.execute("DROP TABLE held; ALTER TABLE summed RENAME TO held")
        self.rows = self.con.execute("SELECT count(*) FROM held").fetchall()[0][0]

    def clear(self) -> None:
        self.con.execute("DELETE FROM held")
        self.rows = 0


def _batches(con, sql: str) -> Iterator[pa.RecordBatch]:
    yield from con.sql(sql).to_arrow_reader(20_000)


#: Terms of each document, then of each group: occurrences and documents.
DOCUMENT_TERMS = f"""
SELECT lang, source, term, sum(n)::BIGINT, count(*) FROM (
  SELECT lang, source, doc, term, count(*) AS n FROM (SELECT lang, source, doc, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM batch) GROUP BY ALL)
GROUP BY ALL"""


def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the documents (lang, source, text) of a task."""
    con = _database()
    counts = Counts(con)
    for batch in batches:
        for part in parts(batch, 2):
            texts = pa.compute.ascii_lower(part.column(2))
            docs = pa.array(range(len(part)), pa.int32())
            counts.add(DOCUMENT_TERMS, pa.RecordBatch.from_arrays([part.column(0), part.column(1), docs, texts], names=["lang", "source", "doc", "text"]))
            if counts.full:
                counts.combine()
                if counts.rows > counts.most // 2:
                    yield from _batches(con, "SELECT * FROM held")
                    counts.clear()
    counts.combine()
    yield from _batches(con, "SELECT * FROM held")
    con.close()


def shard_counts(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Counts of a shard's terms that at least min_docs documents of their lang hold."""
    con = _database()
    counts = Counts(con)
    for batch in batches:
        counts.add("SELECT * FROM batch", batch)
        if counts.full:
            counts.combine()
            counts.most = max(HELD, 2 * counts.rows)
    counts.combine()
    yield from _batches(con, f"SELECT lang, source, term, n, docs FROM held SEMI JOIN (SELECT lang, term FROM held GROUP BY ALL HAVING sum(docs) >= {min_docs}) USING (lang, term)")
    con.close()


#: p of each count that is there, and of the lang; p of an absent term is p0.
_P = "1 + (1000000000::HUGEINT * ({n} + 5)) // ({total} + 5 * v)"
SHARD_P = f"""
CREATE TABLE p AS SELECT c.lang, c.source, c.term, c.n, ({_P.format(n="c.n", total="t.total")})::BIGINT AS p, p0 FROM counts c JOIN (
  SELECT *, ({_P.format(n="0", total="total")})::BIGINT AS p0 FROM totals) t USING (lang, source);
CREATE TABLE q AS SELECT lang, term, ({_P.format(n="c.n", total="t.total")})::BIGINT AS q FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL) c JOIN (
  SELECT lang, any_value(v) AS v, sum(total) AS total FROM totals GROUP BY lang) t USING (lang)"""
#: For each pair and term that one of both holds: how much abs(p - q) differs from that of a term that neither holds.
SHARD_PAIRS = f"""
WITH z AS (SELECT lang, source, ({_P.format(n="0", total="total")})::BIGINT AS p0 FROM totals),
     both_ AS (SELECT a.lang, a.source AS one, b.source AS two, sum(abs(a.p - b.p) - abs(a.p - b.p0) - abs(a.p0 - b.p) + abs(a.p0 - b.p0)) AS f
               FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL),
     alone AS (SELECT p.lang, least(p.source, z.source) AS one, greatest(p.source, z.source) AS two, sum(abs(p.p - z.p0) - abs(p.p0 - z.p0)) AS f
               FROM p JOIN z ON p.lang = z.lang AND p.source <> z.source GROUP BY ALL)
SELECT 'pair' AS part, lang, one AS source, two AS item, sum(f)::BIGINT AS value FROM (FROM both_ UNION ALL FROM alone) GROUP BY ALL"""
SHARD_TERMS = """
SELECT 'term' AS part, lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {most}"""


def shard_sums(counts: pa.Table, totals: pa.Table, most: int) -> pa.Table:
    """Partial pair sums and leading terms of a shard."""
    con = _database()
    con.register("counts", counts)
    con.register("totals", totals)
    con.execute(SHARD_P)
    out = con.sql(f"{SHARD_PAIRS} UNION ALL ({SHARD_TERMS.format(most=most)})").to_arrow_table()
    con.close()
    return out


def divergence(docs: DataFrame, min_docs: int = 30, most_terms: int = 50, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: how far each source of a lang is from the others, and the terms that it
    uses more than the lang does."""
    spark = docs.sparkSession
    ship(spark)
    filled = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counted = filled.mapInArrow(document_counts, COUNTS)
    counts, counts_at = written(counted.repartition("lang", "term").mapInArrow(lambda b: shard_counts(b, min_docs), COUNTS))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = counts.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    groups = filled.select("lang", "source").distinct()
    totals = groups.join(sums, ["lang", "source"], "left").join(terms, "lang", "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    totals, totals_at = written(totals)
    shards = max(1, math.ceil(counts.count() / SHARD_ROWS))
    mine = counts.select("lang", "source", "term", "n", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).alias("shard"))
    every = totals.where("v > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))

    def summed(c: pa.Table, t: pa.Table) -> pa.Table:
        return shard_sums(c, t, most_terms)

    found, found_at = written(mine.groupBy("shard").cogroup(every.groupBy("shard")).applyInArrow(summed, "part string, lang string, source string, item string, value long"))
    # each pair of sources of a lang once, with what the terms make that neither of both holds
    p0 = F.expr("CASE WHEN v > 0 THEN CAST(1 + (CAST(1000000000 AS DECIMAL(38, 0)) * 5) div (total + 5 * v) AS BIGINT) ELSE 0 END")
    plain = totals.select("lang", "source", "v", p0.alias("p0"))
    a, b = plain.alias("a"), plain.alias("b")
    pairs = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") < F.col("b.source"))).select("a.lang", "a.source", F.col("b.source").alias("item"), (F.col("a.v") * F.abs(F.col("a.p0") - F.col("b.p0"))).alias("value"))
    partial = found.where("part = 'pair'").select("lang", "source", "item", "value")
    pairs = pairs.unionByName(partial).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(order).alias("rank")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    leading = found.where("part = 'term'").select("lang", "source", F.lit("term").alias("part"), "item", "value", rank).where(F.col("rank") <= most_terms)
    result, _ = written(pairs.unionByName(leading))
    for p in (counts_at, totals_at, found_at):
        drop_path(spark, p)
    return result
