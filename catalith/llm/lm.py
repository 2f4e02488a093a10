"""Operator 5: language-model scores by prediction by partial matching (PPM) over bytes.

The trie holds byte contexts of order 0 to `order` (5) of the running, ASCII lower-cased text: contexts reach back over white
space and earlier words, down to `order` zero bytes that stand in front of the text; white space is a symbol as it is written,
and a text ends with its own symbol. A symbol unseen in a context costs an escape and is looked for in the next shorter context,
where the symbols of the longer one are excluded. Escape probabilities are estimated from the training counts (secondary
estimation): for contexts of one order, total and number of symbols, the rate at which a symbol left out would have been new.

Longer contexts are nearly always unary chains of the trie, so they are held with their paths compressed: the text is cut where
a hash of the last bytes says so (every SEGMENT bytes on average), and a context is the whole segment before a cut (64-bit
fingerprint), whose symbols are the segments that followed it. A segment unseen there costs an escape and is coded byte by byte.
What a training document itself counted in these contexts is left out when that document is scored, as they would hold it by
heart; so a high score says that other documents have the same passages. The base is a unigram model of the words.

How it runs: documents are dealt into chunks of bounded size. A chunk yields its distinct words, byte windows and segment pairs
with counts. Windows summed over all chunks make the trie, which is evaluated for each distinct window, level by level with
joins on the suffix; of the segment contexts only those found more than once go on. Every chunk gets back its own values and
then streams its documents past them. No table of the corpus is broadcast; memory is bounded by a chunk's distinct words and
windows. A window of up to 7 bytes is one long: its length and its bytes. Words, like segments, go by fingerprints of 63 bits or
more (a clash among a billion words has a chance of some per cent, and then changes two words' counts).

Defined results: null text is empty: one token, the end. Rows that repeat a doc_id are scored each. Rows with a null doc_id
count as training rows. Without training rows all symbols are equally likely. Texts of any length are read in parts of
PART_BYTES, at which a segment ends; a word's fingerprint covers all its bytes, over parts too. Columns other than the key and the text do not matter and are not returned.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.session import drop_path, scratch, ship, written

CHUNK_BYTES, LEAST_CHUNKS = 48_000_000, 12
BLOCK_BYTES, PART_BYTES, LONGEST_WORD = 500_000, 500_000, 4_000_000
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
SEGMENT = 64
LENGTH_BITS = 56
END = b"\xff"  # no byte of UTF-8
ODD = 0xE7037ED1A0B428DB
_NONE = np.uint64(2**64 - 1)


def mixed(codes: np.ndarray) -> np.ndarray:
    h = codes * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def byte_numbers() -> np.ndarray:
    """A number for each byte of a word; white space and the end symbol count nothing."""
    out = mixed(np.arange(1, 257, dtype=np.uint64))
    out[[*range(9, 14), 32, 255]] = 0
    return out


_OF_BYTE = byte_numbers()


class CodeTable:
    """Numbers by code (below 2**64 - 1), all codes of an array at once: open addressing, so a look-up is a few array reads."""

    def __init__(self, bits: int = 16):
        self.bits, self.used = bits, 0
        self.keys, self.values = np.full(1 << bits, _NONE), np.zeros(1 << bits)

    def find(self, codes: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The slot of each code; -1 if it is not held."""
        at = (h >> np.uint64(64 - self.bits)).view(np.int64)
        rest = np.flatnonzero(self.keys[at] != codes)
        mask = (1 << self.bits) - 1
        while len(rest):
            a = at[rest]
            free = self.keys[a] == _NONE
            at[rest[free]] = -1
            rest, a = rest[~free], (a[~free] + 1) & mask
            at[rest] = a
            rest = rest[self.keys[a] != codes[rest]]
        return at

    def insert(self, codes: np.ndarray) -> None:
        """codes: distinct, none held."""
        self.used += len(codes)
        if 2 * self.used > len(self.keys):
            old = self.keys != _NONE
            keys, values = self.keys[old], self.values[old]
            self.bits = max(self.bits + 1, (4 * self.used).bit_length() - 1)
            self.keys, self.values = np.full(1 << self.bits, _NONE), np.zeros(1 << self.bits)
            self._place(keys)
            self.values[self.find(keys, mixed(keys))] = values
        self._place(codes)

    def _place(self, codes: np.ndarray) -> None:
        at = (mixed(codes) >> np.uint64(64 - self.bits)).view(np.int64)
        mask = (1 << self.bits) - 1
        while len(codes):
            free = self.keys[at] == _NONE
            self.keys[at[free]] = codes[free]
            left = self.keys[at] != codes
            codes, at = codes[left], (at[left] + 1) & mask

    def found(self, codes: np.ndarray, h: np.ndarray) -> np.ndarray:
        """As find(), after taking in the codes that are new."""
        at = self.find(codes, h)
        new = np.flatnonzero(at < 0)
        if len(new):
            self.insert(np.unique(codes[new]))
            at = self.find(codes, h)  # slots may have moved
        return at


class Streams:
    """The windows, segments and words of some texts' parts.

    codes: the longest window (context and symbol) of each symbol; h: their hashes; starts: where each part begins;
    text: the number of each part's text; cut: where each segment begins; pair, context: fingerprints of the segments that
    follow another one of their part (at `linked`) with, and of, that one; word, text_of_word: fingerprint and text of each word."""

    _power = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def __init__(self, parts: list[tuple[int, bytes, bytes, bool, int]], order: int):
        """parts: number of the text, `order` bytes in front, bytes (a text's last part ends with END), whether it begins within a word,
        and the sum of what its last word has in later parts (see rest_of_word())."""
        data = b"".join([x for _, front, body, *_ in parts for x in (front, body)]) + bytes(8)
        self.text = np.array([p[0] for p in parts], np.int64)
        n = np.array([len(p[2]) for p in parts], np.int64)
        inside = np.ones(len(data) - 8, bool)
        gaps = np.cumsum(n + order) - order
        inside[(gaps[:, None] + np.arange(order)).ravel()] = False
        raw = np.ndarray((len(data) - 8,), ">u8", data, strides=(1,))[inside].astype(np.uint64)
        raw >>= np.uint64(8 * (7 - order))
        self.codes = raw
        self.h = mixed(raw)
        self.starts = np.cumsum(n) - n
        power, inverse = self.powers(len(raw))
        power = power[: len(raw)]
        ends = (self.h & np.uint64(SEGMENT - 1)) == 0
        ends[self.starts + n - 1] = True
        ends = np.flatnonzero(ends)
        self.cut = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
        segment = np.add.reduceat(self.h * power, self.cut) * inverse[self.cut]
        part = np.searchsorted(self.starts, self.cut, side="right") - 1
        self.text_of_cut = self.text[part]
        self.linked = np.flatnonzero(part[1:] == part[:-1]) + 1
        self.context = segment[self.linked - 1]
        self.pair = mixed(self.context * np.uint64(0xA0761D6478BD642F) + segment[self.linked])
        number = _OF_BYTE[(raw & np.uint64(255)).astype(np.uint8)]
        letter = number != 0
        first = letter.copy()
        first[1:] &= ~letter[:-1]
        first[self.starts] = letter[self.starts] & ~np.array([p[3] for p in parts])
        first = np.flatnonzero(first)
        # a word's sum ends with the word: white space adds nothing; what goes on in a next part is in the sum that the part carries
        until = np.sort(np.concatenate([first, self.starts[[p[3] for p in parts]]])) if any(p[3] for p in parts) else first
        sums = np.add.reduceat(number * power, until)[np.isin(until, first)] if len(first) else np.zeros(0, np.uint64)
        sums *= inverse[first]
        for i in [i for i, p in enumerate(parts) if p[4]]:
            last = np.searchsorted(first, self.starts[i] + n[i]) - 1
            if last >= 0 and first[last] >= self.starts[i]:
                sums[last] = (int(sums[last]) + parts[i][4] * pow(ODD, int(self.starts[i] + n[i] - first[last]), 2**64)) % 2**64
        self.word = mixed(sums) >> np.uint64(1)
        self.text_of_word = self.text[np.searchsorted(self.starts, first, side="right") - 1]

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of an odd number and of its inverse, modulo 2**64."""
        if len(cls._power[0]) < n:
            n = max(n, 2 * BLOCK_BYTES)
            step = np.full((2, n), ODD, np.uint64)
            step[1] = pow(ODD, -1, 2**64)
            step[:, 0] = 1
            cls._power = tuple(np.cumprod(step, axis=1))
        return cls._power


def part_bounds(text: bytes) -> Iterator[tuple[int, int]]:
    """A text in parts of PART_BYTES at most that end before white space; a longer word makes parts of up to LONGEST_WORD bytes."""
    at = 0
    while len(text) - at > PART_BYTES:
        end = max(text.rfind(b" ", at + 1, at + PART_BYTES), text.rfind(b"\n", at + 1, at + PART_BYTES))
        if end < 0:
            found = _SPACE.search(text, at + PART_BYTES, at + LONGEST_WORD)
            end = found.start() if found else min(len(text), at + LONGEST_WORD)
        yield at, end
        at = end
    if at < len(text) or not text:
        yield at, len(text)


def rest_of_word(text: bytes, at: int) -> int:
    """The fingerprint sum of the bytes from `at` to the end of the word there, with the power 0 at `at`; LONGEST_WORD bytes at a time."""
    found = _SPACE.search(text, at)
    end, total = found.start() if found else len(text), 0
    for a in range(at, end, LONGEST_WORD):
        number = _OF_BYTE[np.frombuffer(text[a : min(end, a + LONGEST_WORD)], np.uint8)]
        power, _ = Streams.powers(len(number))
        total += int((number * power[: len(number)]).sum(dtype=np.uint64)) * pow(ODD, a - at, 2**64)
    return total % 2**64


def streams(texts: list[bytes], order: int) -> Iterator[Streams]:
    """All texts (lower case, without their ends) in order, in blocks of bounded size."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for a, b in part_bounds(text):
            front = text[max(0, a - order) : a].rjust(order, b"\0")
            within = lambda x: 0 < x < len(text) and not text[x - 1 : x].isspace() and not text[x : x + 1].isspace()  # noqa: E731, B023
            rest = rest_of_word(text, b) if within(b) and not (within(a) and not _SPACE.search(text, a, b)) else 0
            held.append((i, front, text[a:b] + END if b == len(text) else text[a:b], within(a), rest))
            size += b - a + order + 1
            if size >= BLOCK_BYTES:
                yield Streams(held, order)
                held, size = [], 0
    if held:
        yield Streams(held, order)


class ChunkCounts:
    """Words, windows and segment pairs of a chunk; n: in training rows, m: in the others."""

    def __init__(self, number: int, order: int):
        self.number, self.order = number, order
        self.tables = [CodeTable(), CodeTable()]  # words, windows

    def add(self, texts: list[bytes], held: bool) -> Iterator[pa.RecordBatch]:
        """Takes in texts of one kind; the segment pairs of a block are given out at once."""
        for s in streams([t.lower() for t in texts], self.order):
            for table, codes, h in zip(self.tables, (s.word, s.codes), (mixed(s.word), s.h), strict=True):
                at = table.found(codes, h)
                if not held:
                    table.values += np.bincount(at, minlength=len(table.values))
            pair, first, n = np.unique(s.pair, return_index=True, return_counts=True)
            if len(pair):
                none = np.zeros(len(n), np.int64)
                yield counted_rows(self.number, 2, len(n), code=pair.view(np.int64), ctx=s.context[first].view(np.int64), n=none if held else n, m=n if held else none)

    def result(self) -> Iterator[pa.RecordBatch]:
        for kind, table in enumerate(self.tables):
            on = np.flatnonzero(table.keys != _NONE)
            for a in range(0, len(on), 50_000):
                at = on[a : a + 50_000]
                yield counted_rows(self.number, kind, len(at), code=table.keys[at].view(np.int64), n=table.values[at].astype(np.int64))


_COUNTED = {"chunk": pa.int32(), "kind": pa.int32(), "code": pa.int64(), "ctx": pa.int64(), "n": pa.int64(), "m": pa.int64()}


def counted_rows(chunk: int, kind: int, size: int, **given) -> pa.RecordBatch:
    fixed = {"chunk": np.full(size, chunk, np.int32), "kind": np.full(size, kind, np.int32)} | given
    return pa.RecordBatch.from_arrays([pa.array(fixed[c], k) if c in fixed else pa.nulls(size, k) for c, k in _COUNTED.items()], names=list(_COUNTED))


def _counted(docs: DataFrame, chunks: int, order: int) -> tuple[DataFrame, str]:
    """Rows of all chunks (see _COUNTED) of docs (chunk, held_out, text), written by kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from catalith.llm.lm import ChunkCounts

        now = None
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                rows = list(zip(*(part.column(i).to_pylist() for i in range(3)), strict=True))
                for chunk in dict.fromkeys(r[0] for r in rows):
                    if now is None or now.number != chunk:
                        if now is not None:
                            yield from now.result()
                        now = ChunkCounts(chunk, order)
                    for held in (False, True):
                        yield from now.add([t for c, h, t in rows if c == chunk and h == held], held)
        if now is not None:
            yield from now.result()

    path = scratch(docs.sparkSession)
    dealt = docs.repartitionById(chunks, F.col("chunk")).sortWithinPartitions("chunk")
    counted = dealt.mapInArrow(run, "chunk int, kind int, code long, ctx long, n long, m long")
    counted.write.partitionBy("kind").parquet(path)
    return docs.sparkSession.read.schema(counted.schema).parquet(path), path


LEN = f"shiftright(code, {LENGTH_BITS})"
PREFIX = f"shiftleft({LEN} - 1, {LENGTH_BITS}) | shiftright(code & (shiftleft(1L, {LENGTH_BITS}) - 1), 8)"
SUFFIX = f"shiftleft({LEN} - 1, {LENGTH_BITS}) | (code & (shiftleft(1L, cast(8 * ({LEN} - 1) as int)) - 1))"
MOST_SYMBOLS, MOST_BITS = 12, 20


def _bucket(total: Column) -> Column:
    return F.when(total < 6, total).otherwise(F.least(F.lit(MOST_BITS), F.length(F.bin(total)) + 3)).cast("int")


def bucket(total: np.ndarray) -> np.ndarray:
    return np.where(total < 6, total, np.minimum(MOST_BITS, np.frexp(np.maximum(total, 1).astype(np.float64))[1] + 3)).astype(np.int64)


def _left_out(counts: DataFrame, by: Column) -> list:
    """Rows (o, b, d, n, e): of n symbols left out of a context, e would have been new. counts: c of a symbol, t and d of its context."""
    once = F.col("c") == 1
    keys = [by.alias("o"), _bucket(F.col("t") - 1).alias("b"), F.least(F.col("d") - once.cast("long"), F.lit(MOST_SYMBOLS)).cast("int").alias("d")]
    return counts.where((F.col("c") > 0) & (F.col("t") > 1)).groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.when(once, F.col("c")).otherwise(0)).alias("e")).collect()


class Escapes:
    """Estimated escape probabilities by order, total and number of symbols of a context."""

    def __init__(self, rows: list, orders: int):
        self.rate = np.full((orders, MOST_BITS + 1, MOST_SYMBOLS + 1), np.nan)
        for r in rows:  # orders * buckets at most
            self.rate[r["o"], r["b"], r["d"]] = (r["e"] + 0.5) / (r["n"] + 1)

    def __call__(self, order: int, total: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        r = self.rate[order, bucket(total), np.clip(symbols, 0, MOST_SYMBOLS)]
        return np.where(np.isnan(r), np.maximum(symbols, 1) / np.maximum(total + symbols, 1), r)


def _trie(windows: DataFrame, order: int) -> tuple[DataFrame, str]:
    """Nodes (code, c) with their context's total t, number of symbols d, and x: what the shorter context counts for those symbols."""
    suffixes = f"transform(sequence(1, {order + 1}), i -> shiftleft(cast(i as bigint), {LENGTH_BITS}) | (code & (shiftleft(1L, 8 * i) - 1)))"
    nodes, nodes_at = written(windows.select(F.explode(F.expr(suffixes)).alias("code"), "n").groupBy("code").agg(F.sum("n").alias("c")))
    of = nodes.withColumn("prefix", F.expr(PREFIX)).withColumn("suffix", F.expr(SUFFIX))
    shorter = nodes.select(F.col("code").alias("suffix"), F.col("c").alias("s"))
    seen = F.col("c") > 0
    contexts = of.join(shorter.hint("merge"), "suffix", "left").groupBy("prefix").agg(F.sum("c").alias("t"), F.count_if(seen).alias("d"), F.coalesce(F.sum(F.when(seen, F.col("s"))), F.lit(0)).alias("x"))
    full, full_at = written(nodes.withColumn("prefix", F.expr(PREFIX)).join(contexts.hint("merge"), "prefix").drop("prefix"))
    drop_path(windows.sparkSession, nodes_at)
    return full, full_at


def _levels(full: DataFrame, order: int) -> tuple[DataFrame, str]:
    """code and h, the log10 probability of each window's symbol after its context; level by level of window length.

    Besides h, f is the log probability after an escape from the window's context."""
    escape = Escapes(_left_out(full, F.expr(f"cast({LEN} - 1 as int)")), order + 1)
    spark = full.sparkSession
    path = scratch(spark)
    schema = "code long, h double, f double, c long, t long, d long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            get = lambda c: np.asarray(batch.column(batch.schema.get_field_index(c)).fill_null(0))
            code, c, t, d, x = (get(k) for k in ("code", "c", "t", "d", "x"))
            o = int(code[0] >> LENGTH_BITS) - 1
            with np.errstate(divide="ignore", invalid="ignore"):
                if o:
                    c1, left, more, f1, h1 = get("pc"), get("pt") - x, get("pd") - d, get("pf"), get("ph")
                    e = escape(o - 1, left, more)
                    f = np.where((left <= 0) | (more <= 0), f1, np.where(c1 > 0, np.log10((1 - e) * c1 / left), np.log10(e) + f1))
                else:
                    f = h1 = np.log10(1 / np.maximum(1, 256 - d))
                e = escape(o, t, d)
                h = np.where(d <= 0, h1, np.where(c > 0, np.log10((1 - e) * c / t), np.log10(e) + f))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (code, h, f, c, t, d)], names=["code", "h", "f", "c", "t", "d"])

    for m in range(1, order + 2):
        rows = full.where(F.expr(LEN) == m)
        if m > 1:
            below = spark.read.parquet(f"{path}/m={m - 1}").select(F.col("code").alias("suffix"), *[F.col(k).alias(f"p{k}") for k in "hfctd"])
            rows = rows.withColumn("suffix", F.expr(SUFFIX)).join(below.hint("merge"), "suffix").drop("suffix")
        rows.mapInArrow(run, schema).write.parquet(f"{path}/m={m}")
    mask = (1 << LENGTH_BITS) - 1
    return spark.read.parquet(f"{path}/m={order + 1}").select(F.col("code").bitwiseAND(F.lit(mask)).alias("code"), "h"), path


def _segments(pairs: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Segment pairs whose context is found more than once: (chunk, code) of each chunk, and (code, c, t, d); scratch paths."""
    often = pairs.groupBy("ctx").agg(F.sum("n").alias("t"), F.sum(F.col("n") + F.col("m")).alias("all")).where("t > 0 and all > 1").select("ctx", "t")
    often, often_at = written(often)
    live, live_at = written(pairs.join(often.hint("merge"), "ctx").select("chunk", "code", "ctx", "n", "t"))
    # written, so that AQE can split a context that many different segments follow
    per, per_at = written(live.groupBy("code", "ctx").agg(F.sum("n").alias("c"), F.max("t").alias("t")))
    contexts, contexts_at = written(per.groupBy("ctx").agg(F.count_if(F.col("c") > 0).alias("d")))
    useful, useful_at = written(per.join(contexts.hint("merge"), "ctx"))
    for p in (often_at, per_at, contexts_at):
        drop_path(pairs.sparkSession, p)
    return live.select("chunk", "code").distinct(), useful, [live_at, useful_at]


class ChunkScores:
    """Scores texts with a chunk's own words (counts), windows (logs) and segment pairs."""

    def __init__(self, order: int, escapes: Escapes, total: int, distinct: int, ends: int):
        self.order, self.escapes, self.ends, self.size = order, escapes, ends, total + distinct + 1
        self.tables = [CodeTable(), CodeTable()]
        self.pairs: list[np.ndarray] = []

    def learn(self, kind: int, batch: dict) -> None:
        if kind < 2:
            table, codes = self.tables[kind], np.asarray(batch["code"]).view(np.uint64)
            table.insert(codes)
            table.values[table.find(codes, mixed(codes))] = np.asarray(batch["h" if kind else "c"])
        else:
            self.pairs.append(np.stack([np.asarray(batch[k]) for k in ("code", "ctx", "c", "t", "d")]))

    def ready(self) -> None:
        p = np.concatenate([*self.pairs, np.zeros((5, 0), np.int64)], axis=1)
        p = p[:, np.argsort(p[0].view(np.uint64), kind="stable")]
        self.keys, self.facts = p[0].view(np.uint64).copy(), p[1:]
        self.pairs = []

    def score(self, texts: list[bytes], held: list[bool]) -> list[tuple]:
        """n_tokens, n_known, base_score, score of each text."""
        n = len(texts)
        total, base, known, tokens = np.zeros(n), np.full(n, math.log10((self.ends + 1) / self.size)), np.full(n, self.ends > 0, np.int64), np.ones(n, np.int64)
        found = []
        for s in streams([t.lower() for t in texts], self.order):
            c = self.tables[0].values[self.tables[0].find(s.word, mixed(s.word))]
            base += np.bincount(s.text_of_word, np.log10((c + 1) / self.size), n)
            known += np.bincount(s.text_of_word[c > 0], minlength=n)
            tokens += np.bincount(s.text_of_word, minlength=n)
            logs = self.tables[1].values[self.tables[1].find(s.codes, s.h)]
            total += np.bincount(s.text, np.add.reduceat(logs, s.starts), n)
            if len(self.keys) and len(s.pair):
                at = np.minimum(np.searchsorted(self.keys, s.pair), len(self.keys) - 1)
                hit = self.keys[at] == s.pair
                if hit.any():
                    cost = np.add.reduceat(logs, s.cut)[s.linked[hit]]
                    found.append((s.text_of_cut[s.linked[hit]], at[hit], cost))
        if found:
            total += self.segments(*(np.concatenate(x) for x in zip(*found, strict=True)), ~np.array(held))
        return list(zip(tokens.tolist(), known.tolist(), base.tolist(), total.tolist(), strict=True))

    def segments(self, text: np.ndarray, at: np.ndarray, cost: np.ndarray, train: np.ndarray) -> np.ndarray:
        """What each text's score gains or loses by the segment contexts over coding the segments byte by byte (cost)."""
        ctx, c, t, d = self.facts[:, at]
        order = np.lexsort((at, ctx, text))
        text, at, cost, ctx, c, t, d = (x[order] for x in (text, at, cost, ctx, c, t, d))
        new_ctx = np.concatenate([[True], (text[1:] != text[:-1]) | (ctx[1:] != ctx[:-1])])
        new_pair = new_ctx | np.concatenate([[True], at[1:] != at[:-1]])
        own_ctx, own_pair = (np.repeat(n, n) for n in (np.diff(np.append(np.flatnonzero(x), len(x))) for x in (new_ctx, new_pair)))
        mine = train[text]
        # a training text's own counts are left out
        only = np.add.reduceat((new_pair & (c == own_pair)).astype(np.int64), np.flatnonzero(new_ctx))
        d = d - np.where(mine, only[np.cumsum(new_ctx) - 1], 0)
        c, t = c - np.where(mine, own_pair, 0), t - np.where(mine, own_ctx, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            e = self.escapes(0, t, d)
            gain = np.where(t <= 0, 0.0, np.where(c > 0, np.log10((1 - e) * c / t) - cost, np.log10(e)))
        return np.bincount(text, gain, len(train))


def ppm_scores(docs: DataFrame, held_out: Column, order: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs.

    held_out: rows that are scored only. The other rows train the model."""
    if not 1 <= order <= 6:
        raise ValueError("order is 1 to 6")
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("text"))
    found = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if(~F.col("held_out")).alias("train")).first()
    ends = found["train"] or 0
    chunks = max(LEAST_CHUNKS, math.ceil((found["bytes"] or 0) / CHUNK_BYTES))
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    counted, counted_at = _counted(docs.select("chunk", "held_out", "text"), chunks, order)
    local_words, codes, pairs = (counted.where(F.col("kind") == k) for k in range(3))
    words, words_at = written(local_words.groupBy("code").agg(F.sum("n").alias("c")))
    sums = words.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    total, distinct = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    full, full_at = _trie(codes.groupBy("code").agg(F.sum("n").alias("n")), order)
    levels, levels_at = _levels(full, order)
    live, useful, segments_at = _segments(pairs)
    escapes = Escapes(_left_out(useful, F.lit(0)), 1)
    columns = {"code": "long", "ctx": "long", "c": "long", "t": "long", "d": "long", "h": "double", "doc_id": "long", "held_out": "boolean", "text": "binary"}

    def rows(df: DataFrame, kind: int, *given: str) -> DataFrame:
        return df.select("chunk", F.lit(kind).alias("kind"), *[(F.col(c) if c in given else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])

    mine = rows(local_words.select("chunk", "code").join(words.hint("merge"), "code"), 0, "code", "c")
    mine = mine.unionByName(rows(codes.select("chunk", "code").join(levels.hint("merge"), "code"), 1, "code", "h"))
    mine = mine.unionByName(rows(live.join(useful.hint("merge"), "code"), 2, "code", "ctx", "c", "t", "d"))
    mine, _ = written(mine)
    for p in (full_at, levels_at, words_at, counted_at, *segments_at):
        drop_path(spark, p)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from catalith.llm.lm import BLOCK_BYTES, ChunkScores

        now = chunk = None
        for batch in batches:
            get = dict(zip(batch.schema.names, batch.columns, strict=True))
            which, kind = np.asarray(get["chunk"]), np.asarray(get["kind"])
            cuts = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (kind[1:] != kind[:-1])])) if len(batch) else []
            for a, b in zip(cuts, [*cuts[1:], len(batch)], strict=True):
                if which[a] != chunk:
                    chunk, now = which[a], ChunkScores(order, escapes, total, distinct, ends)
                    ready = False
                if kind[a] < 3:
                    now.learn(int(kind[a]), {c: v.slice(a, b - a) for c, v in get.items()})
                    continue
                if not ready:
                    now.ready()
                    ready = True
                at = a
                while at < b:  # about a block of texts at a time
                    size, end = 0, at
                    while end < b and size < BLOCK_BYTES:
                        size += len(get["text"][end].as_buffer())
                        end += 1
                    ids, held, texts = (get[c].slice(at, end - at).to_pylist() for c in ("doc_id", "held_out", "text"))
                    done = [(i, h, n, k, total, base, s) for i, h, (n, k, base, s) in zip(ids, held, now.score(texts, held), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
                    at = end

    # each chunk's values come before its documents
    together = mine.unionByName(rows(docs, 3, "doc_id", "held_out", "text")).repartitionById(chunks, F.col("chunk")).sortWithinPartitions("chunk", "kind")
    return together.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
