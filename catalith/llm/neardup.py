"""Operator 7: near-duplicate documents by b-bit MinHash.

A narrow map gives each document its number of distinct word shingles, a 128-bit fingerprint of the set, the hashes of its
bands of minima, and the low bits of all minima packed into longs. Documents of one set are one class, represented by the
smallest doc_id, so copies are never compared. Classes that share a band hash meet in a bucket; each bucket has a centre,
the member that shares buckets most, and the buckets of one centre form a group. A group is cut into blocks. First every
block is linked within itself and with the centre; then, in groups of several blocks, members that their block has not connected
with the centre are compared with the other blocks. In a tile the packed bits give each pair a similarity corrected for
chance collisions, and what passes is confirmed on the full shingle sets; pairs already connected are skipped, so a tile
returns a spanning forest and never all pairs. Components come from large-star and small-star rounds.

A link of the required similarity is missed if no band agrees (18 bands of 4: 7.6e-5 at similarity 0.8, 1.7e-6 at 0.85) or
the estimate is 4 standard deviations low (3e-5), and then only if no other link connects the two.

Defined results: null text and texts without words have an empty set and are linked with nothing. Texts of fewer words than
a shingle are one shingle. Rows that repeat a doc_id are one node of the graph, each with its own n_shingles: all sets of a
doc_id are in one component. Rows with a null doc_id are dropped. Texts may be of any length; a task holds the sets of 512
texts at a time. An empty table gives an empty table. Columns other than the key and the text are not read and not returned,
so none can clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith.session import drop_path, ship, written

MINIMA, BANDS, BAND_ROWS, BITS = 128, 18, 4, 2
BLOCK = 256
#: So many ids of 8 bytes are sent to all executors at most; more go by a shuffle.
BROADCAST_IDS = 1_000_000

_P1, _P2, _P3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _P2
    x = (x ^ (x >> np.uint64(27))) * _P3
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles. Words: runs without ASCII white space, ASCII letters in lower case."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode().lower().split()
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(width, len(h))
    if not n:
        return h
    out = np.full(len(h) - n + 1, np.uint64(n))
    for i in range(n):
        out = out * _P1 + h[i : len(h) - n + 1 + i]
    out = mixed(out)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 2**31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, MINIMA, dtype=np.uint32)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """MINIMA minima of each set, none empty."""
    a, b = _functions()
    out = np.empty((len(sets), MINIMA), np.uint32)
    start = 0
    while start < len(sets):
        stop, size = start, 0
        while stop < len(sets) and (size < 32768 or stop == start):
            size += len(sets[stop])
            stop += 1
        x = (np.concatenate(sets[start:stop]) >> np.uint64(32)).astype(np.uint32)
        at = np.cumsum([0, *map(len, sets[start : stop - 1])])
        y = np.empty_like(x)
        for j in range(MINIMA):
            np.multiply(x, a[j], out=y)
            np.add(y, b[j], out=y)
            out[start:stop, j] = np.minimum.reduceat(y, at)
        start = stop
    return out


def packed_bits(m: np.ndarray) -> np.ndarray:
    """The low BITS of each minimum, packed into longs."""
    bits = (m[:, :, None] >> np.arange(BITS, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.reshape(len(m), -1).astype(np.uint8), axis=1, bitorder="little").view(np.int64)


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities of all rows of a with all rows of b from packed bits, corrected for minima that agree in their low bits by chance."""
    low = np.uint64(sum(1 << i for i in range(0, 64, BITS)))
    differs = np.zeros((len(a), len(b)), np.int64)
    for w in range(a.shape[1]):
        x = a[:, None, w].view(np.uint64) ^ b[None, :, w].view(np.uint64)
        for s in range(1, BITS):
            x |= x >> np.uint64(s)
        differs += np.bitwise_count(x & low)
    chance = 0.5**BITS
    return (1 - differs / MINIMA - chance) / (1 - chance)


def least_estimate(similarity: float, sigmas: float = 4.0) -> float:
    chance = 0.5**BITS
    p = similarity + (1 - similarity) * chance
    return similarity - sigmas * math.sqrt(p * (1 - p) / MINIMA) / (1 - chance)


SIGNATURE = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("of_text", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("f1", T.LongType()), T.StructField("f2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("bits", T.ArrayType(T.LongType()))]
)


def signatures(docs: DataFrame, width: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, of_text (hash of the text as it is), n_shingles and, for sets that are not empty, f1, f2, bands, bits."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from catalith.llm.neardup import BAND_ROWS, BANDS, minima, mixed, packed_bits, shingles

        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                sets = [shingles(t, width) for t in part.column(2).to_pylist()]
                some = [i for i, s in enumerate(sets) if len(s)]
                f1, f2 = (np.zeros(len(sets), np.uint64) for _ in range(2))
                bands, bits = [None] * len(sets), [None] * len(sets)
                if some:
                    m = minima([sets[i] for i in some])
                    b = m[:, : BANDS * BAND_ROWS].astype(np.uint64).reshape(len(some), BANDS, BAND_ROWS)
                    k = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(some), 1))
                    for r in range(BAND_ROWS):
                        k = mixed(k * np.uint64(0x9E3779B97F4A7C15) + b[:, :, r])
                    for n, (i, x, y) in enumerate(zip(some, k.view(np.int64), packed_bits(m), strict=True)):
                        bands[i], bits[i] = x, y
                        f1[i], f2[i] = mixed(sets[some[n]] + np.uint64(1)).sum(), mixed(sets[some[n]] ^ np.uint64(0x5851F42D4C957F2D)).sum()
                empty = np.array([not len(s) for s in sets])
                cols = [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(f1.view(np.int64), mask=empty), pa.array(f2.view(np.int64), mask=empty), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "of_text", "n_shingles", "f1", "f2", "bands", "bits"])

    return docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("of_text"), text).mapInArrow(run, SIGNATURE)


class Forest:
    """Union-find of a tile's members."""

    def __init__(self, labels: list):
        first: dict = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def links_in_tile(ids: list[int], labels: list[int], near: list[bool], texts: list[str], bits: np.ndarray, width: int, percent: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Links of a spanning forest between members of different labels (a pair has at least one member marked near); each member's root, by number."""
    forest, out = Forest(labels), []
    estimate = estimated(bits, bits)
    mark = np.array(near)
    i, j = np.nonzero(np.triu(estimate >= least_estimate(percent / 100), 1) & (mark[:, None] | mark[None, :]))
    order = np.argsort(-estimate[i, j], kind="stable")
    sets: dict[int, np.ndarray] = {}
    for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
        if forest.root(a) == forest.root(b):
            continue
        for x in (a, b):
            if x not in sets:
                sets[x] = shingles(texts[x], width)
        both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            forest.join(a, b)
            out.append((ids[a], ids[b]))
    return out, [forest.root(x) for x in range(len(ids))]


def _linked(tiles: DataFrame, width: int, percent: int) -> DataFrame:
    """tiles: tile (string), centre, block, id, of_text, label, near, text, bits. Rows of a tile come together by one shuffle and sort.

    Gives the links (u, v), and where centre is not null (centre, block, u, v) for each member u that is not connected with
    it, v being the smallest member that u is connected with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from catalith.llm.neardup import links_in_tile

        def done(rows: list[dict]) -> list[tuple]:
            seen = {(r["id"], r["of_text"]): r for r in rows}  # a member that is there as itself and as the centre counts once
            for r in rows:
                seen[r["id"], r["of_text"]]["near"] |= r["near"]
            r = list(seen.values())
            if len(r) < 2:
                return []
            ids = [x["id"] for x in r]
            links, root = links_in_tile(ids, [x["label"] for x in r], [x["near"] for x in r], [x["text"] for x in r], np.array([x["bits"] for x in r], np.int64), width, percent)
            found = [(u, v, None, None) for u, v in links]
            if (centre := r[0]["centre"]) is not None:
                least: dict[int, int] = {}
                for i, x in zip(ids, root, strict=True):
                    least[x] = min(i, least.get(x, i))
                main = root[ids.index(centre)]
                found += {(i, least[x], centre, r[0]["block"]) for i, x in zip(ids, root, strict=True) if x != main}
            return found

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["u", "v", "centre", "block"])

        held: list[dict] = []
        out: list[tuple] = []
        for batch in batches:
            for at in range(0, len(batch), 256):
                for row in batch.slice(at, 256).to_pylist():
                    if held and held[0]["tile"] != row["tile"]:
                        out += done(held)
                        held = []
                    held.append(row)
            if out:
                yield batch_of(out)
                out = []
        if held and (out := done(held)):
            yield batch_of(out)

    return tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "u long, v long, centre long, block int")


def components(edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """node, component (smallest node it can reach) for every node of edges (u, v); the scratch paths of the last round.

    Large-star and small-star rounds in turn; each is a minimum by node, joined back, so a node of many edges is no single task."""

    scrap: list[str] = []

    def kept(df: DataFrame) -> DataFrame:
        """Written, so that it is joined by a plain shuffle and AQE can split a node of many edges."""
        out, path = written(df)
        scrap.append(path)
        return out

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = kept(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
            return both.where(F.col("v") > F.col("u")).join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = kept(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        least = kept(down.groupBy("u").agg(F.min("v").alias("m")))
        moved = down.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges, at = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    was = state(edges)
    while was[0]:
        turned, path = written(star(star(edges, large=True), large=False))
        for p in (at, *scrap):
            drop_path(edges.sparkSession, p)
        scrap.clear()
        edges, at, now = turned, path, state(turned)
        if now == was:
            break
        was = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component")), [at]


def _with_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in ids. The ids go to all executors only if they are few enough by count, else both sides are shuffled."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, key, "left_semi")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs. Links: 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    sig, _ = written(signatures(docs, width, text, key))
    some = sig.where(F.col("n_shingles") > 0)
    classes, _ = written(some.groupBy("f1", "f2").agg(F.min("doc_id").alias("cls")))
    same = [some["doc_id"] == classes["cls"], some["f1"] == classes["f1"], some["f2"] == classes["f2"]]
    reps = some.join(classes, same, "left_semi").select(F.col("doc_id").alias("id"), "of_text", "bands", "bits")
    rows = reps.select("id", F.explode("bands").alias("band"))
    full = rows.groupBy("band").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("size")).where("least <> most").select("band", "size")
    full, full_at = written(full)  # aggregates are written before they are joined: AQE then can split a hot band
    members, members_at = written(rows.join(full.hint("merge"), "band"))
    weight, weight_at = written(members.groupBy("id").agg(F.sum("size").alias("weight")))
    centre = members.join(weight.hint("merge"), "id").groupBy("band").agg(F.max(F.struct("weight", -F.col("id"))).alias("best")).select("band", (-F.col("best.col2")).alias("centre"))
    centre, centre_at = written(centre)
    group = members.join(centre.hint("merge"), "band").select("centre", "id").distinct()
    group, group_at = written(group)
    blocks, blocks_at = written(group.groupBy("centre").agg(F.ceil(F.count(F.lit(1)).cast("double") / BLOCK).cast("int").alias("blocks")))
    wanted, wanted_at = written(group.select("id").distinct())
    # texts and bits of the members only; rows that repeat an id and a text are one
    held = _with_ids(docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("of_text"), F.coalesce(F.col(text), F.lit("")).alias("text")), wanted, "id")
    held = held.join(reps.select("id", "of_text", "bits").hint("merge"), ["id", "of_text"]).groupBy("id", "of_text").agg(F.min(F.struct("text", "bits")).alias("x")).select("id", "of_text", "x.text", "x.bits")
    held, held_at = written(held)
    dealt = group.join(blocks.hint("merge"), "centre").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt, dealt_at = written(dealt)
    many = blocks.where("blocks > 1").select("centre", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    tile = lambda *c: F.concat_ws("-", *c)
    parts = ["tile", "centre", "block", "id", "of_text", "label", "near", "text", "bits"]
    labelled = F.when(F.col("blocks") > 1, F.col("centre")).alias("centre")
    inner = dealt.select(tile("centre", "block").alias("tile"), labelled, "block", "id").unionByName(many.select(tile("centre", "block").alias("tile"), "centre", "block", F.col("centre").alias("id")))
    inner = inner.join(held.hint("merge"), "id").withColumns({"label": F.col("id"), "near": F.lit(True)}).select(*parts)
    found, found_at = written(_linked(inner, width, percent))
    drops = [full_at, members_at, weight_at, centre_at, group_at, blocks_at, wanted_at, dealt_at, held_at, found_at]
    links = found.where("centre is null").select("u", "v")
    # groups of several blocks: members that are not connected with the centre against the other blocks
    apart, apart_at = written(found.where("centre is not null").select("centre", "block", F.col("u").alias("id"), F.col("v").alias("label")))
    drops.append(apart_at)
    if not apart.isEmpty():
        wide = dealt.where("blocks > 1").join(apart.select("centre", "id", "label").hint("merge"), ["centre", "id"], "left")
        open_, open_at = written(wide.withColumn("near", F.col("label").isNotNull()).withColumn("label", F.coalesce("label", "centre")))
        active, active_at = written(apart.select("centre", F.col("block").alias("from")).distinct())
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        out = open_.where("near").select("centre", F.col("block").alias("from"), other.alias("to"), "id", "label", "near").where("from <> to")
        into = open_.select("centre", F.col("block").alias("to"), "id", "label").join(active.hint("merge"), "centre").where("from <> to").withColumn("near", F.lit(False))
        cross = out.unionByName(into).select(tile("centre", "from", "to").alias("tile"), F.lit(None).cast("long").alias("centre"), F.lit(None).cast("int").alias("block"), "id", "label", "near").join(held.hint("merge"), "id")
        links, more_at = written(links.unionByName(_linked(cross.select(*parts), width, percent).select("u", "v")))
        drops += [open_at, active_at, more_at]
    known, known_at = components(links)
    # classes are joined to their components first, then documents to classes by two plain shuffles
    named, named_at = written(classes.join(known.withColumnRenamed("node", "cls").hint("merge"), "cls", "left").select("f1", "f2", F.coalesce("component", "cls").alias("component")))
    member = some.select("doc_id", "n_shingles", "f1", "f2").join(named.hint("merge"), ["f1", "f2"])
    # a doc_id with several sets unites their components
    member, _ = written(member.select("doc_id", "n_shingles", "component"))
    united = member.groupBy("doc_id").agg(F.min("component").alias("u"), F.max("component").alias("v")).where("u <> v")
    united, united_at = written(member.join(united.select("doc_id", "u").hint("merge"), "doc_id").where("component <> u").select(F.col("component").alias("u"), F.col("u").alias("v")))
    for p in (*drops, *known_at, named_at):
        drop_path(spark, p)
    if united.isEmpty():
        member = member.select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    else:
        again, again_at = components(united)
        again, _ = written(again.select(F.col("node").alias("component"), F.col("component").alias("component_id")))
        for p in again_at:
            drop_path(spark, p)
        member = member.join(again.hint("merge"), "component", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "component").alias("component_id"))
    drop_path(spark, united_at)
    # a text without words of a doc_id that has other texts is in their component
    others = member.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    alone = sig.where(F.col("n_shingles") == 0).join(others.hint("merge"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return member.unionByName(alone).withColumn("kept", F.col("doc_id") == F.col("component_id"))
