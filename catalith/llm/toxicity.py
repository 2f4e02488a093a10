"""Operator 8: toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

A unit is a run of letters of one sentence, whatever stands between them: a word without its non-letters, neighbouring words
read as one while they have JOIN letters at most ('id iot', 'i di ot'), and overlapping windows of a longer word. The
kernel of two units sums
over common subsequences of 4 letters, each occurrence weighted by DECAY for every letter in its gaps, over spans of up to 8
letters; it is divided by the lengths of both occurrence vectors. So inserted characters, gaps and endings only lower a
match. As the kernel is a product of explicit occurrence vectors, a decision over all landmarks is one table of weights by
subsequence. A text's letters look up their subsequences once; running sums give the decision of every unit.

Training: a bounded sample of labelled documents (SAMPLE of each class, by hash of the id). Units are ranked by how far they
speak for toxic documents; the strongest and the most frequent clean ones are the landmarks. Each document gives one sentence,
whole and of any length, which bears its label; the sentence is known by its witness, the unit that speaks most for toxic
documents: at first by those ranks, then by the last fit. A linear SVM on the Nystroem features of the witnesses is fitted three
times; clean documents' earlier witnesses stay in the training. A document's score is a logistic function,
fitted on the sample (each row weighted by its class's labels to its class's sampled rows), of its largest unit decision; the largest of a sentence's units is the sentence's decision.

Units of fewer than four letters have no subsequence and are never toxic by themselves. Letters other than a to z share 13
codes by their code point, so texts in other scripts are told apart only roughly.

Defined results: null, empty and letterless texts have no unit and get the score of the lowest decision. Repeated rows are
scored each; in training a doc_id counts once, with its smallest text. Texts of any length are scored whole, in pieces of about
PIECE characters between which no unit is lost (see pieces()); a word longer than that is one piece. Labels that disagree on a doc_id count as toxic. An empty table gives an empty table. keep() leaves all columns as they are; score()
returns the key and its own columns, so none can clash. Without both classes in the labels every score is the labels'
rate of toxic rows (0 without labels).
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.session import drop_path, ship, written

LETTERS, SPAN, DECAY = 40, 8, 0.5
SAMPLE, LANDMARKS = 4000, 256
#: Characters of a long text scored as one.
PIECE = 200_000
JOIN = 16
#: Letters of the overlapping windows in words of more than JOIN letters.
WINDOWS = (5, 8, 12, JOIN)
#: Characters scored at once.
SLICE = 200_000
#: Positions behind the first of a subsequence's other three letters, and the weight of its gaps.
OFFSETS = [(a, b, c, DECAY ** (c - 3)) for a, b, c in itertools.combinations(range(1, SPAN), 3)]
LOWEST = -3.0
_WIDE_SPACE = [c for c in range(0x250, 0x3001) if chr(c).isspace()]
_SENTENCE = re.compile(r"[.!?\n]+")
_BLANK = re.compile(r"\s")


def letter_codes() -> np.ndarray:
    """1 to 26 for a to z, 27 to 39 for other letters, 0 for what is skipped; by code point below 0x250."""
    return np.array([ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 13 if c.isalpha() else 0 for c in map(chr, range(0x250))], np.int32)


_CODES = letter_codes()
_SPACES = np.array([chr(c).isspace() for c in range(0x250)])


def occurrences(units: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Per gap pattern: the unit's number, the subsequence's number, the weight, of all occurrences in lower-case units."""
    points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
    unit = np.repeat(np.arange(len(units)), np.fromiter(map(len, units), np.int64, len(units)))
    code = np.where(points < len(_CODES), _CODES[np.minimum(points, len(_CODES) - 1)], 27 + (points % 13).astype(np.int32))
    keep = code > 0
    code, unit = code[keep], unit[keep]
    for a, b, c, weight in OFFSETS:
        n = len(code) - c
        if n <= 0:
            continue
        at = np.flatnonzero(unit[:n] == unit[c:])
        yield unit[at], ((code[at] * LETTERS + code[at + a]) * LETTERS + code[at + b]) * LETTERS + code[at + c], weight


def decisions(units: list[str], table: np.ndarray) -> np.ndarray:
    """Sum of the table over a unit's occurrences, divided by the length of their vector; LOWEST without any."""
    total, square = np.zeros(len(units)), np.zeros(len(units))
    for unit, number, weight in occurrences(units):
        total += np.bincount(unit, table[number] * weight, len(units))
        square += np.bincount(unit, minlength=len(units)) * weight**2
    return np.where(square > 0, total / np.sqrt(np.maximum(square, 1e-12)), LOWEST)


def kernel(units: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel of units with landmarks."""
    row: dict[int, int] = {}
    parts = [(u, x, np.full(len(u), w)) for u, x, w in occurrences(landmarks)]
    mark, number, weight = (np.concatenate([p[i] for p in parts]) for i in range(3)) if parts else (np.zeros(0, np.int64),) * 3
    for x in number.tolist():
        row.setdefault(x, len(row) + 1)
    where = np.zeros(LETTERS**4, np.int32)
    where[list(row)] = list(row.values())
    vectors = np.zeros((len(row) + 1, len(landmarks)), np.float32)
    np.add.at(vectors, (where[number], mark), weight)
    vectors /= np.sqrt(np.maximum(np.bincount(mark, weight**2, len(landmarks)), 1e-12)).astype(np.float32)
    out = np.zeros((len(units), len(landmarks)), np.float32)
    for a in range(0, len(units), 4000):
        part = units[a : a + 4000]
        square = np.zeros(len(part))
        for unit, x, w in occurrences(part):
            square += np.bincount(unit, minlength=len(part)) * w**2
            hit = where[x] > 0
            np.add.at(out, unit[hit] + a, vectors[where[x[hit]]] * np.float32(w))
        out[a : a + 4000] /= np.sqrt(np.maximum(square, 1e-12))[:, None]
    return out


def units_of(words: list[str]) -> list[str]:
    """Units of lower-case words: the words, and runs of at least four single letters as one."""
    out, run = list(words), []
    for w in [*words, "  "]:
        if len(w) == 1:
            run.append(w)
            continue
        if len(run) >= 4:
            out.append("".join(run))
        run = []
    return out


def joined(words: list[str]) -> Iterator[str]:
    """Runs of neighbouring words of one sentence (letters only) read as one, of 4 to JOIN letters."""
    words = [w for w in words if w]
    for i in range(len(words)):
        run = words[i]
        for w in words[i + 1 :]:
            run += w
            if len(run) > JOIN:
                break
            if len(run) >= 4:
                yield run


def sliding(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """The largest decision among the units of each text (LOWEST without any), and that unit's letters."""
    best, units = np.full(len(texts), LOWEST), [""] * len(texts)
    lower = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le"), np.uint32)
    narrow = np.minimum(points, len(_CODES) - 1)
    space = _SPACES[narrow]
    code = _CODES[narrow]
    wide = np.flatnonzero(points >= len(_CODES))
    if len(wide):
        space[wide] = np.isin(points[wide], _WIDE_SPACE)
        code[wide] = np.where(space[wide], 0, 27 + points[wide] % 13)
    # a sentence ends at a line feed and at a word's last character if that is one of .!?
    mark = (points == 33) | (points == 46) | (points == 63)
    ends = points == 10
    ends[1:] |= mark[:-1] & space[1:]
    text_of = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lower])
    letter = np.flatnonzero(code)
    if len(letter) < 4:
        return best, units
    word_of = np.cumsum(space)[letter]  # letters of one word have as many spaces in front
    sentence = np.cumsum(ends)[letter]
    code = code[letter]
    start = np.flatnonzero(np.concatenate([[True], word_of[1:] != word_of[:-1]]))
    end = np.append(start[1:], len(letter))
    sentence, doc = sentence[start], text_of[letter[start]]
    sums = [np.zeros(len(code) + 1) for _ in range(SPAN)]
    second = [code[: len(code) - a] * LETTERS + code[a:] for a in range(SPAN)]
    for a, b, c, weight in OFFSETS:
        n = len(code) - c
        if n > 0:
            sums[c][1 : n + 1] += table[second[a][:n] * (LETTERS * LETTERS) + second[c - b][b : b + n]] * np.float32(weight)
    sums = [np.cumsum(x) for x in sums]
    patterns = Counter(c for *_, c, _ in OFFSETS)

    def decided(s: np.ndarray, e: np.ndarray) -> np.ndarray:
        total, square = np.zeros(len(s)), np.zeros(len(s))
        for c, k in patterns.items():
            total += sums[c][np.maximum(e - c, s)] - sums[c][s]
            square += np.maximum(e - s - c, 0) * (k * DECAY ** (2 * (c - 3)))
        return np.where(square > 0, total / np.sqrt(np.maximum(square, 1e-12)), LOWEST)

    found = [(doc, start, end, decided(start, end))]
    first, k = np.arange(len(start)), 1
    while len(first := first[first + k < len(start)]):
        s, e = start[first], end[first + k]
        fits = (e - s <= JOIN) & (sentence[first] == sentence[first + k])
        first, s, e = first[fits], s[fits], e[fits]
        found.append((doc[first], s, e, decided(s, e)))
        k += 1
    long = np.flatnonzero(end - start > JOIN)
    for window in WINDOWS if len(long) else ():
        n = end[long] - start[long] - window + 1
        s = np.repeat(start[long], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        found.append((np.repeat(doc[long], n), s, s + window, decided(s, s + window)))
    at = np.full(len(texts), -1)
    of, s, e, d = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.argsort(of, kind="stable")
    of, d = of[by], d[by]
    begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    top = np.maximum.reduceat(d, begin)
    best[of[begin]] = top
    hit = np.flatnonzero(d == np.repeat(top, np.diff(np.append(begin, len(d)))))
    at[of[hit][::-1]] = by[hit][::-1]
    for i in of[begin].tolist():
        if best[i] > LOWEST:
            units[i] = "".join(map(chr, points[letter[s[at[i]] : e[at[i]]]].tolist()))
    return best, units


@dataclass
class ToxicModel:
    """weights by subsequence (sparse), and the logistic function of the largest decision."""

    numbers: np.ndarray
    weights: np.ndarray
    slope: float
    shift: float

    def table(self) -> np.ndarray:
        out = np.zeros(LETTERS**4, np.float32)
        out[self.numbers] = self.weights
        return out

    def score(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decision + self.shift, -30, 30)))


def fit_svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton-like steps on the active set; y is -1 or 1."""
    x = np.hstack([z, np.ones((len(z), 1))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    ridge = penalty * weight.sum() * np.eye(len(w))
    ridge[-1, -1] *= 1e-3
    for _ in range(rounds):
        on = y * (x @ w) < 1
        xa, wa = x[on], weight[on]
        new = np.linalg.solve((xa * wa[:, None]).T @ xa + ridge, xa.T @ (wa * y[on]))
        if np.abs(new - w).max() < 1e-8:
            break
        w = 0.5 * w + 0.5 * new
    return w[:-1], w[-1]


def _units(texts: DataFrame) -> DataFrame:
    """unit, toxic, n: in how many documents of each label a unit is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from catalith.llm.toxicity import units_of

        seen = {0: Counter(), 1: Counter()}
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[toxic].update({"".join(filter(str.isalpha, u)) for u in units_of((text or "").lower().split())})
        for toxic, c in seen.items():
            words = list(c)
            for a in range(0, len(words), 20_000):
                w = words[a : a + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array([toxic] * len(w), pa.int32()), pa.array([c[x] for x in w], pa.int64())], names=["unit", "toxic", "n"])

    return texts.select("toxic", "text").mapInArrow(run, "unit string, toxic int, n long").where(F.char_length("unit") >= 4)


def first_witness(text: str | None, evidence: dict[str, float]) -> str:
    """The unit of a text with the strongest evidence, ties to the smaller; without any, the first word that is a unit ('' if none)."""
    best, found, plain = 0.0, "", ""
    for sentence in _SENTENCE.split((text or "").lower()):
        words = ["".join(filter(str.isalpha, w)) for w in sentence.split()]
        for u in itertools.chain(units_of(words), joined(words)):
            e = evidence.get(u, 0.0)
            if e > best or (e == best and e and u < found):
                best, found = e, u
        plain = plain or next((w for w in words if len(w) >= 4), "")
    return found or plain


def _first_witnesses(texts: DataFrame, evidence: dict[str, float]) -> DataFrame:
    """toxic and the first witness of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from catalith.llm.toxicity import first_witness

        for batch in batches:
            found = [first_witness(t, evidence) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["toxic", "unit"])

    return texts.select("toxic", "text").mapInArrow(run, "toxic int, unit string").where("unit <> ''")


def _next_witnesses(texts: DataFrame, model: ToxicModel) -> DataFrame:
    """toxic and the unit with the largest decision of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from catalith.llm.bpe import parts
        from catalith.llm.toxicity import Decided

        decided = Decided(model)
        for batch in batches:
            for part in parts(batch, 1, PIECE):
                found = decided.units(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string())], names=["toxic", "unit"])

    return texts.select("toxic", "text").mapInArrow(run, "toxic int, unit string").where("unit <> ''")


def folded(landmarks: list[str], beta: np.ndarray) -> ToxicModel:
    """A decision over landmarks (sum of beta times the normalised kernel) as one weight for each subsequence."""
    lengths = np.zeros(len(landmarks))
    for unit, _, weight in occurrences(landmarks):
        lengths += np.bincount(unit, minlength=len(landmarks)) * weight**2
    table = np.zeros(LETTERS**4)
    for unit, number, weight in occurrences(landmarks):
        np.add.at(table, number, beta[unit] / np.sqrt(lengths[unit]) * weight)
    numbers = np.flatnonzero(table)
    return ToxicModel(numbers, table[numbers].astype(np.float32), 1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> ToxicModel:
    """labels: key, toxic 0/1. Only the sample's texts are read into the training jobs; rows of bounded number come to the driver."""
    ship(docs.sparkSession)
    labels = labels.where(F.col(key).isNotNull() & F.col("toxic").isin(0, 1)).groupBy(key).agg(F.max("toxic").cast("int").alias("toxic"))
    total = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    # the sample's rows stand for all of their class in the probabilities
    stands = {y: n / min(n, sample) for y, n in total.items()}
    chosen = [labels.where(F.col("toxic") == y).orderBy(F.xxhash64(key), key).limit(sample) for y in (0, 1)]
    # 2 * sample ids at most
    texts = docs.select(key, text).join(F.broadcast(chosen[0].unionByName(chosen[1])), key)
    texts, path = written(texts.groupBy(key).agg(F.max("toxic").alias("toxic"), F.min(text).alias("text")).select("toxic", "text"))
    have = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(have) < 2:
        drop_path(docs.sparkSession, path)
        return ToxicModel(np.zeros(0, np.int64), np.zeros(0), 0.0, 30.0 if have.get(1) else -30.0)
    n = [F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(0)) for y in (0, 1)]
    counts, counts_at = written(_units(texts).groupBy("unit").agg(n[0].alias("clean"), n[1].alias("bad")))
    odds = F.log((F.col("bad") + 0.5) / (have[1] + 1)) - F.log((F.col("clean") + 0.5) / (have[0] + 1))
    strong = counts.where(F.col("bad") > 1).withColumn("e", F.col("bad") * odds).where("e > 0").orderBy(F.desc("e"), "unit").limit(8 * LANDMARKS).collect()
    plain = counts.where(odds < 0).orderBy(F.desc("clean"), "unit").limit(LANDMARKS).collect()
    evidence = {r["unit"]: float(r["e"]) for r in strong}
    seen = {y: [] for y in (0, 1)}
    for r in _first_witnesses(texts, evidence).collect():  # one of each document of the sample
        seen[r["toxic"]].append(r["unit"])
    drop_path(docs.sparkSession, counts_at)
    landmarks = [r["unit"] for r in strong[: LANDMARKS // 2]] + [r["unit"] for r in plain[: LANDMARKS // 2]]
    if not landmarks or not seen[0] or not seen[1]:
        drop_path(docs.sparkSession, path)
        rate = have[1] * stands[1] / (have[0] * stands[0] + have[1] * stands[1])
        return ToxicModel(np.zeros(0, np.int64), np.zeros(0), 0.0, math.log(rate / (1 - rate)))
    value, vector = np.linalg.eigh(kernel(landmarks, landmarks).astype(np.float64))
    good = value > 1e-6
    root = vector[:, good] / np.sqrt(value[good])
    negatives = [r["unit"] for r in plain]
    sure = [r["unit"] for r in strong if r["bad"] >= 5 and r["clean"] * have[1] < 0.02 * r["bad"] * have[0]]
    for again in range(3):
        bad, good = seen[1] + sure, seen[0] + negatives
        pool = sorted({*bad, *good})
        place = {u: i for i, u in enumerate(pool)}
        features = (kernel(pool, landmarks) @ root)[np.array([place[u] for u in bad + good])]
        y = np.array([1.0] * len(bad) + [-1.0] * len(good))
        weight = np.where(y > 0, 1 / len(bad), 1 / len(good)) * len(y)
        w, bias = fit_svm(features, y, weight)
        model = folded(landmarks, root @ w)
        if again < 2:  # what looks worst in clean documents so far stays among the clean units
            negatives += seen[0]
            seen = {y: [] for y in (0, 1)}
            for r in _next_witnesses(texts, model).collect():
                seen[r["toxic"]].append(r["unit"])
    scored = score(texts.withColumn("id", F.lit(0).cast("long")), model, text="text", key="id", carry="toxic").select("toxic", "decision").collect()
    drop_path(docs.sparkSession, path)
    d, t = np.array([r["decision"] for r in scored]), np.array([r["toxic"] for r in scored], float)
    each = np.where(t > 0, stands[1], stands[0])
    t = np.where(t > 0, 1 - 1 / (t.sum() + 2), 1 / ((1 - t).sum() + 2))  # Platt's targets
    x, ab = np.stack([d + bias, np.ones(len(d))], axis=1), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        step = np.linalg.solve((x * (each * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-4 * np.eye(2), x.T @ (each * (p - t)) + 1e-4 * ab)
        ab -= np.clip(step, -5, 5)
    return ToxicModel(model.numbers, model.weights, float(ab[0]), float(ab[0] * bias + ab[1]))


def pieces(text: str | None) -> list[str]:
    """A text, or a long one in pieces that have all its units between them: cut behind a sentence, which no unit crosses. In a
    sentence longer than PIECE the cut is at white space, and the next piece begins with the last words of the one before, as far
    as units reach over words; a longer word is never cut."""
    text = text or ""
    if len(text) <= PIECE:
        return [text]
    out, at, before = [], 0, ""
    while len(text) - at > PIECE:
        end = at + PIECE
        cut = max(text.rfind("\n", at, end) + 1, *(text.rfind(m, at, end) + 2 for m in (". ", "! ", "? ")))
        if cut > at + 1:
            out.append(before + text[at:cut])
            at, before = cut, ""
            continue
        cut = text.rfind(" ", at + 1, end)
        if cut < 0:
            found = _BLANK.search(text, end)
            cut = found.start() if found else len(text)
        out.append(before + text[at:cut])
        held, letters = [], 0
        for w in reversed(out[-1].split()):
            w = "".join(filter(str.isalpha, w))
            letters += len(w)
            if letters > JOIN:
                break
            held.append(w)
        at, before = cut, " ".join(reversed(held))
    return [*out, before + text[at:]]


class Decided:
    """Decisions of texts, some of them at a time."""

    def __init__(self, model: ToxicModel):
        self.table = model.table()

    def _each(self, texts: list[str | None]) -> Iterator[tuple[int, float, str]]:
        """Number of the text, decision and unit of every piece."""
        from catalith.llm.bpe import slices

        cut = [(i, p) for i, t in enumerate(texts) for p in pieces(t)]
        for a, b in slices([p for _, p in cut], SLICE):
            best, units = sliding([p for _, p in cut[a:b]], self.table)
            yield from zip([i for i, _ in cut[a:b]], best.tolist(), units, strict=True)

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """The largest decision among the units of each text."""
        out = np.full(len(texts), LOWEST)
        for i, d, _ in self._each(texts):
            out[i] = max(out[i], d)
        return out

    def units(self, texts: list[str | None]) -> list[str]:
        """The unit with the largest decision of each text."""
        best: list[tuple[float, str]] = [(LOWEST, "")] * len(texts)
        for i, d, u in self._each(texts):
            if d > best[i][0]:
                best[i] = (d, u)
        return [u for _, u in best]


def score(docs: DataFrame, model: ToxicModel, text: str = "text", key: str = "doc_id", carry: str | None = None) -> DataFrame:
    """key, decision, score (and one integer column carried along) of each row of docs: a narrow map."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, " + (f"{carry} int, " if carry else "") + "decision double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from catalith.llm.bpe import parts
        from catalith.llm.toxicity import Decided

        decided = Decided(model)
        for part in (p for batch in batches for p in parts(batch, batch.num_columns - 1)):
            d = decided.documents(part.column(part.num_columns - 1).to_pylist())
            cols = [part.column(i) for i in range(part.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(d), pa.array(model.score(d))], names=[f.split()[0] for f in schema.split(", ")])

    return docs.select(key, *([carry] if carry else []), text).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, held_out, score, predicted, decision. held_out: a column over key; labels of held-out rows are not used."""
    held = F.coalesce(held_out, F.lit(False))
    model = fit(docs, labels.where(~held), text, key)
    out = score(docs, model, text, key)
    return out.withColumn("held_out", held).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, model: ToxicModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, all columns as they are; a narrow map without a join."""
    ship(docs.sparkSession)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from catalith.llm.bpe import parts
        from catalith.llm.toxicity import Decided

        decided = Decided(model)
        for part in (p for batch in batches for p in parts(batch, place)):
            fine = model.score(decided.documents(part.column(place).to_pylist())) < threshold
            yield part.filter(pa.array(fine))

    return docs.mapInArrow(run, docs.schema)
