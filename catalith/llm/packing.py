"""Operator 6: sum-of-squares online packing of token sequences.

Each Spark partition packs its documents as they come. A level array counts the open windows of each fill; a document's
part goes to the level that least raises the sum of squared counts. What fills whole windows by itself is cut off first. A
window closes if at most capacity / 128 tokens are missing, which is padding. At the end of a partition, or when MOST_OPEN
windows are open, the pieces of the open windows are taken out and placed again by the same rule, ROUNDS times: largest first,
then in an order of chance. What is open after that is topped up: the emptiest windows give their pieces, cut as needed, to the
fullest ones. A last run of less than a window is cut into powers of two, which need no padding. `made` tells for each piece
what made its sequence: placed, joined (placed again), topped or cut.

Defined results: null or empty text is a document of one token, the end. Repeated rows are packed each as a document of
its own. Sequence ids are unique over the whole table: the partition's number in the upper bits. Equal costs go to the fuller
window. A text of any length is cut into whole windows as it comes; only tails of less than a window wait, so a task holds
MOST_OPEN windows at most. An empty table gives an empty table. Columns other than the key and the text are not read and not
returned, so none can clash.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from catalith.session import ship


MOST_OPEN, ROUNDS = 4096, 4
#: Bytes of text that are encoded at once.
AT_ONCE = 3_000_000


class SquareSumPacker:
    """Pieces are (document, start, length); place() and drain() return finished sequences: how each was made, its pieces."""

    def __init__(self, capacity: int, most_open: int = MOST_OPEN):
        self.capacity, self.most_open, self.full = capacity, most_open, capacity - capacity // 128
        self.clear()

    def clear(self) -> None:
        self.count = np.zeros(self.capacity + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(self.capacity)]
        self.n_open = 0

    def level(self, size: int) -> int:
        """The fill level (0: a new window) whose use adds least to the sum of squared counts; ties to the fuller one."""
        n, cap = self.count, self.capacity
        here = n[1 : cap - size + 1]
        there = n[size + 1 : cap + 1]
        cost = np.where(here > 0, 2 * there - 2 * here + 2, np.iinfo(np.int64).max)
        if not len(cost):
            return 0
        closes = max(0, self.full - size - 1)
        cost[closes:] -= here[closes:] > 0  # a full window is no longer counted
        new = 2 * n[size] + 1
        best = len(cost) - 1 - int(np.argmin(cost[::-1]))
        return best + 1 if cost[best] <= new else 0

    def put(self, pieces: list[tuple], size: int) -> list[tuple] | None:
        """Places pieces of less than a window as one; the window if that closes it."""
        h = self.level(size)
        window = self.open[h].pop() if h else []
        if h:
            self.count[h] -= 1
            self.n_open -= 1
        window += pieces
        if h + size >= self.full:
            return window
        self.open[h + size].append(window)
        self.count[h + size] += 1
        self.n_open += 1
        return None

    def place(self, doc, start: int, length: int) -> Iterator[tuple[str, list[tuple]]]:
        """A document's part; whole windows are to be cut off before."""
        if window := self.put([(doc, start, length)], length):
            yield "placed", window
        if self.n_open > self.most_open:
            yield from self.drain()

    def drain(self) -> Iterator[tuple[str, list[tuple]]]:
        chance = random.Random(self.n_open)
        for turn in range(ROUNDS):
            pieces = [p for level in self.open for window in level for p in window]
            self.clear()
            if turn % 2:
                chance.shuffle(pieces)
            else:
                pieces.sort(key=lambda p: -p[2])
            for p in pieces:
                if window := self.put([p], p[2]):
                    yield "joined", window
        windows = [(h, w) for h in range(self.capacity) for w in self.open[h]]
        self.clear()
        spare: list[tuple] = []  # pieces of the emptiest windows, which fill up the fullest ones
        emptiest, held = 0, 0

        def take(room: int) -> list[tuple]:
            nonlocal held
            out = []
            held -= room
            while room:
                doc, start, length = spare.pop()
                out.append((doc, start, min(room, length)))
                if room < length:
                    spare.append((doc, start + room, length - room))
                room -= min(room, length)
            return out

        while len(windows) > emptiest:
            h, window = windows.pop()
            while held < self.capacity - h and emptiest < len(windows):
                held += windows[emptiest][0]
                spare += windows[emptiest][1]
                emptiest += 1
            if held < self.capacity - h:
                spare += window
                held += h
                break
            yield "topped", window + take(self.capacity - h)
        while held:
            yield "cut", take(min(self.capacity, 1 << (held.bit_length() - 1)))


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each piece: key, start, length, ids (binary), doc_tokens, sequence_id, offset, sequence_tokens, made."""
    ship(docs.sparkSession)
    out = T.StructType(
        [T.StructField(key, docs.schema[key].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("start", "length")]
        + [T.StructField("ids", T.BinaryType())]
        + [T.StructField(c, T.LongType()) for c in ("doc_tokens", "sequence_id", "offset", "sequence_tokens")]
        + [T.StructField("made", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from catalith.llm.bpe import encoder, parts
        from catalith.llm.packing import AT_ONCE

        enc, packer, end = encoder(path), SquareSumPacker(capacity), end_id.to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def finish(made: str, window: list[tuple]) -> None:
            """A document of a piece: key, ids from `begin` on, tokens of the whole document."""
            nonlocal sequence
            offset, total = 0, sum(p[2] for p in window)
            for (k, begin, ids, tokens), start, length in window:
                rows.append((k, start, length, ids[4 * (start - begin) : 4 * (start - begin + length)], tokens, sequence, offset, total, made))
                offset += length
            sequence += 1

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[f.name for f in out])

        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.string()]
        for batch in batches:
            types[0] = batch.schema.field(0).type
            for part in parts(batch, 1, AT_ONCE):
                keys = part.column(0).to_pylist()
                ids, upto = enc.encode_many(part.column(1).to_pylist())
                data, upto = ids.astype("<u4").tobytes(), upto.tolist()
                for k, i, j in zip(keys, upto, upto[1:], strict=False):
                    tokens = j - i + 1
                    whole = tokens - tokens % capacity
                    mine = (k, 0, data[4 * i : 4 * j] + end, tokens)
                    for start in range(0, whole, capacity):
                        finish("placed", [(mine, start, capacity)])
                    if tokens > whole:
                        for made, window in packer.place((k, whole, mine[2][4 * whole :], tokens), whole, tokens - whole):
                            finish(made, window)
                if rows:
                    yield batch_of()
        for made, window in packer.drain():
            finish(made, window)
            if len(rows) >= 10_000:
                yield batch_of()
        if rows:
            yield batch_of()

    return docs.select(key, text).mapInArrow(run, out)
