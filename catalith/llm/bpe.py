"""Operator 9: BPE encoding and decoding with a pair occurrence index.

A batch of new words goes into one symbol list with left and right links. An index maps each mergeable pair to all its
positions; active ranks leave a heap in ascending order, every position of that pair is merged, and only the lists of
the pairs left and right of a merge change. As a merge never makes a pair of lower rank active (the vocabulary's merges
are ordered so; checked on loading), this equals merging each word on its own.

Defined results: null text is the empty text, which has no ids and decodes to ''. Repeated rows are encoded each. The
strings of special tokens in a text are the special ids, as the library has it. Rows may be of any length: a text is
read in pieces of about PIECE_CHARS, cut at white space, and only words not in the Python worker's store (REMEMBER words at
most, and those of GROUP_CHARS of text) are merged. An empty table gives an empty table. Ties do not occur: ranks are distinct. Columns
other than the key and the text are not read and not returned, so none can clash.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from catalith.session import ship

PIECE_CHARS, GROUP_CHARS, REMEMBER = 500_000, 4_000_000, 250_000
_LETTER = "a-zªµºß-öø-ÿĀ-įı-ſ"
_DIGIT = "0-9²³¹¼-¾"
#: Texts of only these characters need no Unicode normalisation and have the same classes in every regex library.
_ODD = re.compile("[^\t\n\r -~¡-¬®-Įįı-ſ‐-‧€]")
_BLANK = re.compile("[ \t\n\r]")
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\s{_LETTER}{_DIGIT}]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class Slots(dict):
    """Numbers words as they are first asked for; new: those not yet encoded."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        i = self[word] = len(self)
        return i


class PairIndexEncoder:
    """A vocabulary of word-end BPE (JSON of the tokenizers library), with a bounded store of words already encoded."""

    def __init__(self, path: str, remember: int = REMEMBER):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = dict(spec["model"]["vocab"])
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.ids = vocab
        self.tokens = {i: s for s, i in (vocab | self.special).items()}
        self.merges: dict[int, int] = {}  # left symbol and right symbol in one integer: rank
        self.pair_of: list[tuple[int, int, int]] = []
        born: dict[int, int] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            left, right, new = vocab[a], vocab[b], vocab[a + b]
            if max(born.get(left, -1), born.get(right, -1)) > rank:
                raise ValueError("a merge uses a symbol that only a later merge makes")
            self.merges[(left << 20) | right] = rank
            self.pair_of.append((left, right, new))
            born.setdefault(new, rank)
        self.keys = np.array(sorted(self.merges), np.int64)
        self.key_ranks = np.array([self.merges[k] for k in self.keys.tolist()], np.int64)
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], np.int32)
        self.final = np.array([vocab[c + self.suffix] for c in alphabet], np.int32)
        self.byte_of = {c: i for i, c in enumerate(alphabet)}
        self.path, self.remember = path, remember
        self.split_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self._library = None
        self.reset()

    def _slow_pieces(self, part: str) -> list[str]:
        """Pieces of a text with characters outside the plain set, by the library's own normaliser and splitter."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        t = self._library
        pieces = t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(part))
        return [bytes(map(self.byte_of.__getitem__, p)).decode() for p, _ in pieces]

    def merge(self, data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all pieces at once through the pair occurrence index.

        data: the pieces' UTF-8 end to end; lengths: bytes of each, none 0. Returns the ids and the number for each piece.
        Ranks with many positions are merged as arrays, the others one position at a time; both share the same links."""
        raw = np.frombuffer(data, np.uint8)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        n = len(raw)
        sym_of = array("i", bytes(4 * n))
        nxt_of, prv_of = array("i", bytes(4 * n)), array("i", bytes(4 * n))
        sym, nxt, prv = (np.frombuffer(x, np.int32) for x in (sym_of, nxt_of, prv_of))
        sym[:] = self.inner[raw]
        sym[ends - 1] = self.final[raw[ends - 1]]
        nxt[:] = np.arange(1, n + 1)
        nxt[ends - 1] = -1
        prv[:] = np.arange(-1, n - 1)
        prv[starts] = -1
        where: dict[int, list] = {}  # rank: positions, as ints and arrays
        active: list[int] = []

        def index(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> None:
            """Add positions at of pairs to the lists of the ranks that merge them."""
            keys = (left.astype(np.int64) << 20) | right
            slot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[slot] == keys
            ranks, at = self.key_ranks[slot[hit]], at[hit]
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order]
            cuts = np.flatnonzero(np.diff(ranks, prepend=-1))
            for r, part in zip(ranks[cuts].tolist(), np.split(at, cuts[1:]) if len(cuts) else (), strict=True):
                if (got := where.get(r)) is None:
                    where[r] = [part]
                    heapq.heappush(active, r)
                else:
                    got.append(part)

        if n > 1:
            has = np.flatnonzero(nxt >= 0)
            index(sym[has], sym[has + 1], has)
        ranks_of, pair_of = self.merges, self.pair_of
        while active:
            rank = heapq.heappop(active)
            a, b, new = pair_of[rank]
            lists = where.pop(rank)
            many = sum(len(x) if isinstance(x, np.ndarray) else 1 for x in lists)
            if many >= 48 and a != b:
                i = np.sort(np.concatenate([np.atleast_1d(x) for x in lists]))
                i = i[(sym[i] == a) & (np.diff(i, prepend=-1) > 0)]
                j = nxt[i]
                ok = (j >= 0) & (sym[j] == b)
                i, j = i[ok], j[ok]
                k = nxt[j]
                sym[i], sym[j], nxt[i] = new, -1, k
                some = k >= 0
                prv[k[some]] = i[some]
                index(np.full(int(some.sum()), new), sym[k[some]], i[some])
                p = prv[i]
                p = p[p >= 0]
                index(sym[p], np.full(len(p), new), p)
                continue
            places = sorted(y for x in lists for y in (x.tolist() if isinstance(x, np.ndarray) else (x,)))
            for i in places:
                if sym_of[i] != a or (j := nxt_of[i]) < 0 or sym_of[j] != b:
                    continue
                sym_of[i], sym_of[j] = new, -1
                k = nxt_of[i] = nxt_of[j]
                p = prv_of[i]
                if k >= 0:
                    prv_of[k] = i
                    if (r := ranks_of.get((new << 20) | sym_of[k])) is not None:
                        if r in where:
                            where[r].append(i)
                        else:
                            where[r] = [i]
                            heapq.heappush(active, r)
                if p >= 0 and (r := ranks_of.get((sym_of[p] << 20) | new)) is not None:
                    if r in where:
                        where[r].append(p)
                    else:
                        where[r] = [p]
                        heapq.heappush(active, r)
        stays = sym >= 0
        return sym[stays], np.add.reduceat(stays, starts, dtype=np.int64) if n else np.zeros(0, np.int64)

    def learn(self) -> None:
        """Encode the words that have a slot but no ids yet, all in one index."""
        new = self.store.new
        if not new:
            return
        pieces = [[w] if w.isalpha() else [w[1:]] if w[0] == "\0" else _PIECE.findall(w) for w in new]
        number: dict[str, int] = {}  # words that differ in their punctuation share pieces
        which = np.array([number.setdefault(p, len(number)) for words in pieces for p in words], np.int64)
        data = [p.encode() for p in number]
        ids, counts = self.merge(b"".join(data), np.fromiter(map(len, data), np.int64, len(data)))
        begin, size = np.cumsum(counts) - counts, counts[which]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = ids[np.repeat(begin[which] - upto[:-1], size) + np.arange(upto[-1])]
        upto = upto[np.cumsum([0, *map(len, pieces)])]
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + upto[1:]])
        self.flat = np.concatenate([self.flat, ids])
        new.clear()

    def reset(self) -> None:
        self.store = Slots()
        self.flat, self.bounds = np.array([*self.special.values()], np.int32), np.arange(len(self.special) + 1)
        for word in self.special:
            self.store["\0\0" + word] = len(self.store)

    def _keys(self, text: str) -> list[str]:
        """Words of a text; special tokens and pieces of unusual text are marked as such by a zero in front."""
        if "<|" not in text or self.split_special is None:
            spans = []
        else:
            spans = [(m.start(), m.end()) for m in self.split_special.finditer(text)]
        if not spans and not _ODD.search(text):
            return text.lower().split()
        out, at = [], 0
        for a, b in [*spans, (len(text), len(text))]:
            part = text[at:a]
            out += ["\0" + p for p in self._slow_pieces(part)] if _ODD.search(part) else part.lower().split()
            if b > a:
                out.append("\0\0" + text[a:b])
            at = b
        return out

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text begins and ends."""
        pieces, upto = [], [0]
        for t in texts:
            pieces += cut(t or "")
            upto.append(len(pieces))
        done = [x for a, b in slices(pieces, GROUP_CHARS) for x in self._encode_group(pieces[a:b])]
        counts = np.concatenate([n for _, n in done]) if done else np.zeros(0, np.int64)
        ids = done[0][0] if len(done) == 1 else np.concatenate([np.zeros(0, np.int32), *(i for i, _ in done)])
        return ids, np.concatenate([[0], np.cumsum(counts)])[upto]

    def _encode_group(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For some texts at a time: their ids end to end, and the number of each text's.

        Texts become numbers of words piece by piece; the new words of the whole group are indexed together."""
        if len(self.store) > self.remember:
            self.reset()
        numbered = []
        for a, b in slices(texts):
            keys = [self._keys(t) if t else [] for t in texts[a:b]]
            n = np.fromiter(map(len, keys), np.int64, len(keys))
            numbered.append((n, np.fromiter(map(self.store.__getitem__, itertools.chain.from_iterable(keys)), np.int32, int(n.sum()))))
        self.learn()
        for n, slots in numbered:
            first = self.bounds[slots]
            count = self.bounds[slots + 1] - first
            upto = np.concatenate([[0], np.cumsum(count)])
            ids = self.flat[np.repeat(first - upto[:-1], count) + np.arange(upto[-1])]
            yield ids, np.diff(upto[np.concatenate([[0], np.cumsum(n)])])

    def decode(self, ids: np.ndarray) -> str:
        """Token strings joined by blanks, as the library decodes where its file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> PairIndexEncoder:
    """One for each Python worker and vocabulary; the store of words outlives a task."""
    return PairIndexEncoder(path)


def cut(text: str) -> list[str]:
    """A text as it is, or a long one in pieces of about PIECE_CHARS that end before white space."""
    out, at = [], 0
    while len(text) - at > PIECE_CHARS and (m := _BLANK.search(text, at + PIECE_CHARS)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]] if at else [text]


def slices(texts: list, chars: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so many characters each, so that a batch of long texts stays small in memory."""
    chars = chars or PIECE_CHARS
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def parts(batch: pa.RecordBatch, column: int, size: int = GROUP_CHARS) -> Iterator[pa.RecordBatch]:
    """A batch in slices with about so many bytes of text each; texts become Python strings a slice at a time."""
    bytes_of = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(bytes_of.tolist(), 1):
        total += n
        if total >= size:
            yield batch.slice(start, i - start)
            start, total = i, 0
    if start < len(batch):
        yield batch.slice(start)


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", decode: bool = False) -> DataFrame:
    """One row for each of docs: the key, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded if asked for.

    A narrow map: no shuffle, whole texts, Python only sees the key and the text."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    if decode:
        out.add("decoded", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from catalith.llm.bpe import encoder, parts

        enc = encoder(path)
        for batch in batches:
            for part in parts(batch, 1):
                ids, upto = enc.encode_many(part.column(1).to_pylist())
                data = [None, pa.py_buffer((4 * upto).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))]
                cols = [part.column(0), pa.array(np.diff(upto)), pa.Array.from_buffers(pa.binary(), len(part), data)]
                if decode:
                    cols.append(pa.array([enc.decode(ids[i:j]) for i, j in itertools.pairwise(upto.tolist())], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in out])

    return docs.select(key, text).mapInArrow(run, out)
