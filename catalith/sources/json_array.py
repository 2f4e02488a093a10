"""Elements of a top-level JSON array of objects, read in splits: no file, however large, is one task or one string.

Spark reads the file as records that end with a closing brace, in splits of its own, from any store. Whether a split begins
inside a string and how deep is not known there, so two narrow passes are made. The first gives for each split what it does
to either state (in a string or not), depth and least depth: a few numbers, put together in the file's order. The second
passes over the splits with their true states and cuts the elements; those that cross splits are put together by a shuffle of
these alone."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.session import ship, written

#: Splits whose states are put together on the driver: some hundred bytes each.
MOST_SPLITS = 2_000_000
QUOTE, BACKSLASH = 34, 92


def steps(data: np.ndarray, inside: bool) -> tuple[np.ndarray, bool]:
    """For each byte +1 for an opening and -1 for a closing bracket outside strings, else 0; and whether the end lies in a string."""
    quotes = np.flatnonzero(data == QUOTE)
    if len(quotes):
        slashes = data == BACKSLASH
        if slashes.any():
            plain = np.maximum.accumulate(np.where(slashes, -1, np.arange(len(data))))
            before = np.where(quotes > 0, quotes - 1 - plain[quotes - 1], 0)
            quotes = quotes[before % 2 == 0]
    flips = np.zeros(len(data) + 1, np.int64)
    flips[quotes + 1] = 1
    within = (np.cumsum(flips) + inside) % 2
    out = np.isin(data, np.frombuffer(b"{[", np.uint8)).astype(np.int64) - np.isin(data, np.frombuffer(b"}]", np.uint8))
    out[within[:-1] == 1] = 0
    return out, bool(within[-1])


def effect(data: bytes, before: tuple[bool, int, int]) -> tuple[bool, int, int]:
    """(in a string, change of depth, least change so far) after data."""
    inside, depth, least = before
    step, inside = steps(np.frombuffer(data, np.uint8), inside)
    change = depth + np.cumsum(step)
    return inside, int(change[-1]) if len(change) else depth, min(least, int(change.min())) if len(change) else least


def states(effects: list[tuple]) -> dict[tuple, tuple[bool, int, int]]:
    """(file, split): (in a string, depth, split in which the open element began) from the splits' effects, sorted.

    effects: (file, split, in_0, depth_0, least_0, in_1, depth_1, least_1), by whether the split begins in a string."""
    out = {}
    for file, splits in groupby(sorted(effects), key=lambda e: e[0]):
        inside, depth, owner = False, 0, -1
        for _, split, *both in splits:
            out[file, split] = (inside, depth, owner)
            into, change, least = both[3:] if inside else both[:3]
            if depth < 2 or depth + least < 2:
                owner = split  # an element that is open at the end began here
            inside, depth = bool(into), depth + change
    return out


def elements(chunks: Iterator[bytes], inside: bool, depth: int) -> Iterator[tuple[bytes, bool, bool]]:
    """(text, begins here, ends here) of the bracketed elements of a split: whole ones, and the parts of those that cross its ends."""
    pending, begun = [], depth < 2
    for chunk in chunks:
        data = np.frombuffer(chunk, np.uint8)
        step, inside = steps(data, inside)
        level = depth + np.cumsum(step)
        was = level - step
        starts = np.flatnonzero((was == 1) & (level == 2))
        ends = np.flatnonzero((was == 2) & (level == 1)) + 1
        at = 0 if depth >= 2 else None
        s = e = 0
        while True:
            if at is None:
                if s == len(starts):
                    break
                at, s, begun = int(starts[s]), s + 1, True
            while e < len(ends) and ends[e] <= at:
                e += 1
            if e == len(ends):
                pending.append(chunk[at:])
                break
            yield b"".join([*pending, chunk[at : ends[e]]]), begun, True
            pending, at, e, begun = [], None, e + 1, True
        depth = int(level[-1]) if len(level) else depth
    if pending:
        yield b"".join(pending), begun, False


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """((file, split), chunks) of rows (file, split, record); each record gets back the brace that ended it."""

    def runs() -> Iterator[tuple[tuple, bytes]]:
        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            values = b.column(2).to_pylist()
            at = 0
            for key, group in groupby(keys):
                n = len(list(group))
                yield key, ("}".join(values[at : at + n]) + "}").encode()
                at += n

    for key, group in groupby(runs(), key=lambda r: r[0]):
        yield key, (chunk for _, chunk in group)


EFFECTS = "file string, split long, in_0 boolean, depth_0 long, least_0 long, in_1 boolean, depth_1 long, least_1 long"
PARTS = "file string, owner long, split long, text string, whole boolean"


def _table(rows: list[tuple], kinds: list[pa.DataType], names: str) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[n.split()[0] for n in names.split(", ")])


def split_effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), *[pa.bool_(), pa.int64(), pa.int64()] * 2]
    for key, chunks in _splits(batches):
        out, quoted = (False, 0, 0), (True, 0, 0)
        for chunk in chunks:
            out, quoted = effect(chunk, out), effect(chunk, quoted)
        yield _table([(*key, *out, *quoted)], kinds, EFFECTS)


def split_elements(batches: Iterator[pa.RecordBatch], known: dict) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    rows: list[tuple] = []
    for (file, split), chunks in _splits(batches):
        inside, depth, owner = known[file, split]
        for text, begins, ends in elements(chunks, inside, depth):
            if not (begins and ends and text.startswith(b"[")):
                rows.append((file, split if begins else owner, split, text.decode(), begins and ends))
            if len(rows) == 1000:
                yield _table(rows, kinds, PARTS)
                rows.clear()
    if rows:
        yield _table(rows, kinds, PARTS)


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """A row `text` for each object in the top-level arrays of the files at path; other elements are left out."""
    ship(spark)
    records = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    effects, _ = written(records.mapInArrow(split_effects, EFFECTS))
    if effects.count() > MOST_SPLITS:
        raise ValueError(f"more than {MOST_SPLITS} splits; read with larger ones")
    known = spark.sparkContext.broadcast(states([tuple(r) for r in effects.collect()]))
    parts, _ = written(records.mapInArrow(lambda b: split_elements(b, known.value), PARTS))
    crossing = parts.where(~F.col("whole")).groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("split", "text"))).alias("p"))
    joined = crossing.select(F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text")).where(F.startswith("text", F.lit("{")))
    return parts.where("whole").select("text").unionByName(joined)
