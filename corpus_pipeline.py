"""A corpus pipeline: toxicity, line dedup, near-duplicates, packing. Each stage works on all its predecessor kept.

All stages take null in any column (a null text is an empty one; rows with a null doc_id are compared with
nothing and stay), texts of any length, repeated rows and empty tables; the first three return the columns of documents,
so further columns of the input, whatever their names, are left out.

ORACLE_SQL is None: the toxicity classifier and the packing can't be written in SQL; tests hold the stages against
brute-force versions."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.llm import lines, neardup, packing, toxicity
from catalith.llm.registry import WORD_BPE
from catalith.session import read_table, written

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC_SCORE = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, gives less than TOXIC_SCORE. Each row is scored by itself, repeated ones
    alike; empty texts and texts without letters stay. Without labels all stay."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    kept = toxicity.keep(docs.select(*DOCUMENTS), model, TOXIC_SCORE)
    return kept


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters and more that 5 documents share stay in the document of the largest doc_id only; documents left with
    white space only go. Rows that repeat a doc_id are one document in the counts. n_chars follows the text where lines went."""
    out = lines.drop_repeated_lines(docs, min_chars=40, min_docs=5)
    left = (F.col("n_dropped") == 0) | (F.btrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")) != "")
    return out.where(left).select("doc_id", "text", "lang", "source", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8) stays: the smallest doc_id, with all its rows. Texts without
    words are alike to nothing and stay."""
    found = neardup.near_duplicates(docs, width=5, percent=80)
    extra = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(extra.hint("merge"), "doc_id", "left_anti").select(*DOCUMENTS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; every row, repeated and empty ones too, is in them whole."""
    return packing.pack(docs, public_tokenizers.path(WORD_BPE), capacity=2048, end_id=1)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_dedup", drop_near_duplicates), ("packing", pack_sequences)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
