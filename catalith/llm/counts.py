"""Operator 13: token counts with the whole-token shortcut.

Before the job, whole_tokens() proves which strings of the vocabulary encode alone as one token: all of them are merged from
their bytes, and those left as one symbol are whole. (A string of the vocabulary need not be: other merges may take its letters
first.) The proven set is as large as the vocabulary at most and goes to the tasks as a broadcast. A task counts pre-tokens
in that set directly as one; only the rest is merged, and the counts of such words are kept, REMEMBER of them at most.

Defined results: null text is the empty text, with no bytes and no tokens. Repeated rows are counted each. Strings of special
tokens in a text are one token each, as the library has it by default. A text of any length is read in pieces cut at white
space and counted whole. An empty table gives an empty table. Ties do not occur. Columns other than the key and the text are
not read and not returned, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith.llm.bpe import _PIECE, GROUP_CHARS, PairIndexEncoder, cut, slices
from catalith.session import ship

REMEMBER = 500_000
#: What a vocabulary may hold so that its proven strings are broadcast: some megabytes.
MOST_STRINGS = 1_000_000


def pieces_of(word: str) -> list[str]:
    """Pre-tokens of a word between blanks; a zero in front marks one that is a pre-token already."""
    if word[0] == "\0":
        return [word[1:]]
    return [word] if word.isalpha() else _PIECE.findall(word)


@lru_cache(maxsize=2)
def whole_tokens(path: str) -> frozenset[str]:
    """The pre-tokens that the vocabulary at path encodes as one token: strings that the splitter leaves as they are, each proved
    by merging it from its bytes."""
    enc = PairIndexEncoder(path)
    if len(enc.ids) > MOST_STRINGS:
        raise ValueError(f"more than {MOST_STRINGS} strings in {path}")
    texts = []
    for symbols in enc.ids:
        letters = symbols.removesuffix(enc.suffix)
        if letters in ("", symbols):
            continue
        try:
            text = bytes(map(enc.byte_of.__getitem__, letters)).decode()
        except UnicodeDecodeError:  # part of a character: no pre-token
            continue
        if [p for w in enc._keys(text) for p in pieces_of(w)] == [text]:
            texts.append(text)
    data = [t.encode() for t in texts]
    _, tokens = enc.merge(b"".join(data), np.fromiter(map(len, data), np.int64, len(data)))
    return frozenset(t for t, n in zip(texts, tokens.tolist(), strict=True) if n == 1)


class WholeTokenCounter:
    """Counts tokens of texts: proven pre-tokens as one, others by merging them. New words of many texts are merged together."""

    def __init__(self, path: str, whole: frozenset[str], remember: int = REMEMBER):
        self.enc, self.whole, self.remember = PairIndexEncoder(path), whole, remember
        self.known: dict[str, int] = {}  # tokens of words
        self.tokens: dict[str, int] = {}  # tokens of merged pre-tokens
        self.direct = self.merged = 0  # words of proven pre-tokens only, pre-tokens merged

    def _learn(self, words: list[str]) -> None:
        whole, known, merged = self.whole, self.known, self.tokens
        rest: list[tuple[str, int, list[str]]] = []
        for w in words:
            if w in whole or w.startswith("\0\0"):
                known[w] = 1
                continue
            pieces = pieces_of(w)
            left = [p for p in pieces if p not in whole]
            if left:
                rest.append((w, len(pieces) - len(left), left))
            else:
                known[w] = len(pieces)
        new = list({p for _, _, left in rest for p in left}.difference(merged))
        if new:
            data = [p.encode() for p in new]
            _, tokens = self.enc.merge(b"".join(data), np.fromiter(map(len, data), np.int64, len(data)))
            merged.update(zip(new, tokens.tolist(), strict=True))
        for w, n, left in rest:
            known[w] = n + sum(map(merged.__getitem__, left))
        self.direct += len(words) - len(rest)
        self.merged += len(new)

    def count_many(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text. Texts are cut at white space, so that GROUP_CHARS are worked on at a time."""
        pieces = [(i, part) for i, t in enumerate(texts) for part in cut(t or "") if part]
        totals = [0] * len(texts)
        for a, b in slices([part for _, part in pieces], GROUP_CHARS):
            words = [self.enc._keys(part) for _, part in pieces[a:b]]
            for store in (self.known, self.tokens):
                if len(store) > self.remember:
                    store.clear()
            new = set().union(*words).difference(self.known)
            if new:
                self._learn(list(new))
            for (i, _), mine in zip(pieces[a:b], words, strict=True):
                totals[i] += sum(map(self.known.__getitem__, mine))
        return totals


_counters: dict[str, WholeTokenCounter] = {}


def counter(path: str, whole: frozenset[str]) -> WholeTokenCounter:
    """One for each Python worker and vocabulary; its store outlives a task."""
    if path not in _counters:
        _counters[path] = WholeTokenCounter(path, whole)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each of docs: the key, n_bytes (UTF-8), n_tokens, over_limit (more than limit tokens).

    A narrow map: no shuffle, whole texts, Python only sees the key and the text."""
    ship(docs.sparkSession)
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))
    out = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from catalith.llm.bpe import parts
        from catalith.llm.counts import counter

        mine = counter(path, whole.value)
        for batch in batches:
            for part in parts(batch, 1):
                sizes = pa.compute.fill_null(pa.compute.binary_length(part.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(mine.count_many(part.column(1).to_pylist()), pa.int64())], names=[f.name for f in out])

    counted = docs.select(key, text).mapInArrow(run, out)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
