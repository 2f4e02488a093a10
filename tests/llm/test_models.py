import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalith.llm import lm, toxicity

def held_column():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "and", "thing", "other", "a", "Running", "der", "und", "ding", "über", "ä"]
    rows = []
    for i in range(n):
        rows.append((i, " ".join(rng.choice(words) + rng.choice(["", ".", "s", str(rng.randint(0, 99))]) for _ in range(rng.randint(0, 40)))))
    passage = " ".join(rng.choice(words) + str(rng.randint(0, 9)) for _ in range(200))
    copies = [(2000 + i, rows[i % 3][1] + "\n" + passage + " " + str(i)) for i in range(12)] + [(2000, passage * 2), (3000, "et " * 400), (3001, "Et " * 500)]
    return rows + copies + [(1000, None), (1001, ""), (1002, "\n\t x"), (1003, "z" * 3000), (1004, "\x00a\x00")]


def tokens(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


def cut(text, order):
    """Segments of a text, each with the bytes that its first window reaches back to; by plain integers."""
    def ends(w):
        h = int.from_bytes(w, "big") * 0x9E3779B97F4A7C15 % 2**64
        h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 % 2**64
        return (h ^ h >> 29) % lm.SEGMENT == 0

    q, out, begin = bytes(order) + text, [], order
    for k in range(order, len(q)):
        if ends(q[k - order : k + 1]) or k == len(q) - 1:
            out.append((begin, k + 1, q[begin - order : k + 1]))
            begin = k + 1
    return q, out


def ppm_by_hand(rows, order):
    """Scores by a plain dictionary version of the same model."""
    lower = {k: "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "").encode() + b"\xff" for k, r in enumerate(rows)}
    train = [k for k, r in enumerate(rows) if not held(r[0])]
    total, grams, follows, own = Counter(), Counter(), Counter(), {}
    for k, text in lower.items():
        q, segments = cut(text, order)
        own[k] = Counter((a[2], b[2]) for a, b in zip(segments, segments[1:]))
        for i in range(order, len(q)):
            for o in range(order + 1):
                grams[q[i - o : i + 1]] += k in train
        if k in train:
            total.update(tokens(rows[k][1]))
            follows.update(own[k])
    n, v = sum(total.values()) + len(train), len(total) + 1
    grams = Counter({g: c for g, c in grams.items() if c})
    bucket = lambda z: z if z < 6 else min(20, int(math.log2(z)) + 4)

    def rates(counts, order_of):
        t, d = Counter(), Counter()
        for (c, _), k in counts.items():
            t[c] += k
            d[c] += 1
        seen, new = defaultdict(int), defaultdict(int)
        for (c, _), k in counts.items():
            if t[c] > 1:
                key = (order_of(c), bucket(t[c] - 1), min(12, d[c] - (k == 1)))
                seen[key] += k
                new[key] += k * (k == 1)

        def escape(o, left, more):
            key = (o, bucket(left), min(12, more))
            return (new[key] + 0.5) / (seen[key] + 1) if key in seen else max(more, 1) / max(left + more, 1)

        return t, d, escape

    t, d, escape = rates({(g[:-1], g[-1:]): k for g, k in grams.items()}, len)
    _, _, long_escape = rates(follows, lambda c: 0)
    x = Counter()
    for g in grams:
        if len(g) > 1:
            x[g[:-1]] += grams[g[1:]]

    def symbol(ctx, s):
        out, last = 0.0, None
        while True:
            if d[ctx]:
                left, more = t[ctx] - (x[last] if last is not None else 0), d[ctx] - (d[last] if last is not None else 0)
                if left > 0 and more > 0:
                    e = escape(len(ctx), left, more)
                    if grams[ctx + s]:
                        return out + math.log10((1 - e) * grams[ctx + s] / left)
                    out += math.log10(e)
                last = ctx
            if not ctx:
                return out + math.log10(1 / (256 - d[b""]))
            ctx = ctx[1:]

    out = []
    for k, (i, text) in enumerate(rows):
        ws = tokens(text)
        base = sum(math.log10((total[w] + 1) / (n + v + 1)) for w in ws) + math.log10((len(train) + 1) / (n + v + 1))
        q, segments = cut(lower[k], order)
        logs = [symbol(q[j - order : j], q[j : j + 1]) for j in range(order, len(q))]
        rest = follows - own[k] if k in train else follows
        score = 0.0
        for j, (a, b, segment) in enumerate(segments):
            cost = sum(logs[a - order : b - order])
            after = {s: c for (f, s), c in rest.items() if j and f == segments[j - 1][2]}
            if not after:
                score += cost
                continue
            e = long_escape(0, sum(after.values()), len(after))
            score += math.log10((1 - e) * after[segment] / sum(after.values())) if segment in after else math.log10(e) + cost
        out.append((i, held(i), len(ws) + 1, sum(total[w] > 0 for w in ws) + 1, n, base, score))
    return out


@pytest.mark.parametrize("order", [2, 5])
def test_ppm_equals_the_plain_version(spark, order):
    rows = corpus(order)
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n0 int")
    got = lm.ppm_scores(df, held_column(), order=order).collect()
    plain = lambda r: (r[0], r[2], r[6])
    assert len(got) == len(rows)
    for r, want in zip(sorted(map(tuple, got), key=plain), sorted(ppm_by_hand(rows, order), key=plain), strict=True):
        assert r[:5] == want[:5]
        assert r[5] == pytest.approx(want[5], abs=1e-9) and r[6] == pytest.approx(want[6], rel=1e-6)


def test_ppm_parts_of_long_texts(monkeypatch):
    """A text read in parts has the windows and words of the whole text; segments end where a part does."""
    rng = random.Random(1)
    text = ("".join(rng.choice("abcd \n") for _ in range(5000)) + "x" * 4000 + " e " + "y" * 2000).encode()
    whole = next(lm.streams([text], 5))
    assert len(whole.word) == len(text.split()) == len(whole.text_of_word) and len(set(whole.word.tolist())) == len(set(text.split()))
    monkeypatch.setattr(lm, "PART_BYTES", 700)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 1500)
    for longest in (10_000, 1000):
        monkeypatch.setattr(lm, "LONGEST_WORD", longest)
        parts = list(lm.streams([b"x", text, b""], 5))
        assert len(parts) > 2
        codes, words = (np.concatenate([getattr(s, x) for s in parts]) for x in ("codes", "word"))
        assert codes[2:-1].tolist() == whole.codes.tolist()
        assert words[1:].tolist() == whole.word.tolist()
        assert sorted(set(np.concatenate([s.text for s in parts]).tolist())) == [0, 1, 2]
    bounds = list(lm.part_bounds(text))
    assert [a for a, _ in bounds[1:]] == [b for _, b in bounds[:-1]] and bounds[-1][1] == len(text) and max(b - a for a, b in bounds) <= 1000


def test_words_that_differ_after_many_parts_are_two_words(monkeypatch):
    """Words longer than any part are told apart by all their bytes; equal ones are one word wherever parts end."""
    word = "ab" * 3000
    texts = [word + "c", word + "d", "q " + word + "c", "some words before it " + word + "d e", word, word[:-1]]
    plain = [s.word.tolist() for s in lm.streams([t.encode() for t in texts], 5)]
    for part, longest in ((700, 900), (100, 130), (1000, 6001)):
        monkeypatch.setattr(lm, "PART_BYTES", part)
        monkeypatch.setattr(lm, "LONGEST_WORD", longest)
        monkeypatch.setattr(lm, "BLOCK_BYTES", 2000)
        found = [w for s in lm.streams([t.encode() for t in texts], 5) for w in s.word.tolist()]
        assert found == [w for ws in plain for w in ws] and len(set(found)) == len({w for t in texts for w in t.split()})


def test_code_table_holds_what_it_was_given():
    rng = np.random.default_rng(1)
    table, held = lm.CodeTable(4), {}
    for _ in range(20):
        codes = rng.integers(0, 3000, 500).astype(np.uint64)
        at = table.found(codes, lm.mixed(codes))
        assert (table.keys[at] == codes).all()
        table.values += np.bincount(at, minlength=len(table.values))
        for c in codes.tolist():
            held[c] = held.get(c, 0) + 1
    keys = np.array(list(held), np.uint64)
    assert table.values[table.find(keys, lm.mixed(keys))].tolist() == list(held.values())
    other = np.array([5000, 2**47], np.uint64)
    assert table.find(other, lm.mixed(other)).tolist() == [-1, -1]


def test_ppm_without_rows_or_training(spark):
    schema = "doc_id long, text string"
    assert lm.ppm_scores(spark.createDataFrame([], schema), held_column()).count() == 0
    got = lm.ppm_scores(spark.createDataFrame([(1, "a b"), (1, "a b")], schema), F.lit(True)).collect()
    assert len(got) == 2 and got[0]["n_known"] == 0 and got[0]["score"] == pytest.approx(4 * math.log10(1 / 256), rel=1e-6)


def test_ppm_is_a_distribution_over_next_symbols(spark):
    """Symbols after a context: probabilities of all one-byte continuations sum to at most 1, close to it."""
    rows = [(i, t) for i, t in enumerate(["ab ab ac", "abc ab", "b"] * 5)]
    probe = [(10_000 + i, "ab" + chr(i)) for i in range(1, 127) if chr(i) == chr(i).lower()] + [(10_000, "ab")]
    got = {r["doc_id"]: r["score"] for r in lm.ppm_scores(spark.createDataFrame(rows + probe, "doc_id long, text string"), F.col("doc_id") >= 10_000).collect()}
    want = {i: s for i, _, _, _, _, _, s in ppm_by_hand([(i if i < 10_000 else i * 7, t) for i, t in rows], 5)}
    assert len(want) == len(rows) and 0 < sum(10 ** got[i] for i, *_ in probe) <= 1


def test_ppm_contexts_cross_words_and_find_copies(spark):
    """The order of the words and the white space between them matter; a text whose copy was learnt from scores far above others."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    texts = [" ".join(word() for _ in range(150)) for _ in range(60)]
    rows = [(i, "one two\nsix ten " * 5) for i in range(20)] + [(200 + i, t) for i, t in enumerate(texts)] + [(300, texts[0])]
    probe = [(100, "one two\nsix ten"), (101, "ten six two\none"), (102, "one two six ten"), (400, texts[1])]
    df = spark.createDataFrame(rows + probe, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.ppm_scores(df, F.col("doc_id").isin(*[i for i, _ in probe])).collect()}
    assert got[100] > got[101] + 1 and got[100] > got[102] + 1
    alone = [got[200 + i] for i in range(2, 60)]
    for i in (200, 300, 400):  # in training twice, in training once and scored once
        assert got[i] > max(alone) + 50
    assert got[201] < max(alone) + 50  # its copy was not learnt from


def toxic_corpus(seed, n=400):
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ren", "tis", "vor", "an", "el"]
    bad = ["idiot", "moron", "scumbag", "pathetic"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(60)]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(3):
                words.insert(rng.randint(0, 60), rng.choice(bad))
        rows.append((i, ". ".join(" ".join(words[k : k + 10]) for k in range(0, len(words), 10))))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_held_out_and_disguised(spark):
    rows, labels = toxic_corpus(1)
    extra = [(5000, None), (5001, ""), (5002, "123 ..."), (5003, "ka lo mi " * 20000), (5004, "you are an id-iot"), (5005, "a i d i o t b"), (5006, "mi scum.bag vor"), (5007, "what a mor0on lo"), (5008, "ka lo\nren tis")]
    schema = "doc_id long, text string"
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    docs = spark.createDataFrame(rows + extra, schema).withColumns({c: F.lit("clash") for c in ("toxic", "score", "decision", "unit")})
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), held_out).collect()}
    test = [(got[i]["predicted"], y) for i, y in labels if got[i]["held_out"]]
    assert len(test) > 60 and sum(p == y for p, y in test) / len(test) > 0.98
    assert all(got[i]["predicted"] == 1 for i in (5004, 5005, 5006, 5007)), {i: got[i]["score"] for i in range(5004, 5008)}
    assert all(got[i]["predicted"] == 0 for i in (5000, 5001, 5002, 5003, 5008))
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_toxicity_across_blanks_and_in_long_runs(spark):
    rows, labels = toxic_corpus(1)
    split = ["id iot", "mor on", "i di ot", "i d iot", "s c um b ag", "path et ic", "kalomi" * 5 + "idiot" + "rentis" * 5]
    extra = [(5000 + i, f"ka lo. mi {x} vor ren") for i, x in enumerate(split)] + [(6000, "ka lo id. iot vor"), (6001, "kalomi" * 20)]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(spark.createDataFrame(rows + extra, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(False)).collect()}
    assert [got[5000 + i] for i in range(len(split))] == [1] * len(split)
    assert got[6000] == got[6001] == 0
    assert sum(got[i] == y for i, y in labels) / len(labels) > 0.98


def test_toxicity_keeps_the_rate_of_the_labels_past_the_sample(spark):
    """Scores are probabilities at the labels' rate, however small the sample of each class is."""
    rows, _ = toxic_corpus(2, 600)
    rng = random.Random(4)
    labels = [(i, int(rng.random() < (0.3 if re.search("idiot|moron|scumbag|pathetic", t) else 0.05))) for i, t in rows]
    docs, given = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    rate = sum(y for _, y in labels) / len(labels)
    assert rate < 0.2
    for sample in (40, 4000):
        scores = toxicity.score(docs, toxicity.fit(docs, given, sample=sample)).agg(F.avg("score")).first()[0]
        assert abs(scores - rate) < 0.08, (sample, scores, rate)


def test_sliding_units_equal_the_units_one_by_one():
    rng = np.random.default_rng(3)
    table = rng.normal(size=toxicity.LETTERS**4).astype(np.float32)
    texts = [None, "", "abc", "a-bc d, ef. gh ij klm\nno pqrst! u", "x" * 5 + "abcdefghij" * 4, "äö ü\u2003ω ab - cd", "i d i o t"]
    got, units = toxicity.sliding(texts, table)
    for text, best, unit in zip(texts, got, units, strict=True):
        found = []
        for sentence in re.split(r"\n|(?<=[.!?])\s", (text or "").lower()):
            words = ["".join(filter(str.isalpha, w)) for w in sentence.split()]
            found += [w for w in words if w] + list(toxicity.joined(words))
            found += [w[i : i + n] for w in words if len(w) > toxicity.JOIN for n in toxicity.WINDOWS for i in range(len(w) - n + 1)]
        d = toxicity.decisions(found, table) if found else np.zeros(0)
        assert best == pytest.approx(max(d, default=toxicity.LOWEST), rel=1e-5)
        if len(d) and max(d) > toxicity.LOWEST:
            assert toxicity.decisions([unit], table)[0] == pytest.approx(best, rel=1e-5)


def test_the_svm_is_at_its_optimum_and_folds_into_weights():
    """The fit against its own definition: no direction lowers the loss; the table of weights decides as the landmarks do."""
    rng = np.random.default_rng(5)
    y = np.where(rng.random(300) < 0.3, 1.0, -1.0)
    z = rng.normal(size=(300, 6)) + y[:, None] * 0.4
    weight = rng.random(300) + 0.5

    def loss(w, b):
        return (weight * np.maximum(0, 1 - y * (z @ w + b)) ** 2).sum() / weight.sum() + 1e-3 * ((w**2).sum() + 1e-3 * b**2)

    w, b = toxicity.fit_svm(z, y, weight)
    least = loss(w, b)
    for _ in range(200):
        step = rng.normal(size=7) * rng.choice([1e-3, 1e-2, 0.1])
        assert loss(w + step[:6], b + step[6]) >= least - 1e-9
    marks, units = ["idiot", "moronic", "plain", "words", "abcabc"], ["idiot", "id1iot", "moron", "wordplain", "xyz", "abc", "zzzzz"]
    beta = rng.normal(size=5)
    model = toxicity.folded(marks, beta)
    want = toxicity.kernel(units, marks) @ beta
    got = toxicity.decisions([u.replace("1", "x") for u in units], model.table()), toxicity.kernel([u.replace("1", "x") for u in units], marks) @ beta
    some = [i for i, u in enumerate(units) if len(u) >= 4]
    assert np.allclose(got[0][some], got[1][some], atol=1e-5) and len(want) == len(units)


def test_first_witness_by_hand():
    evidence = {"idiot": 3.0, "moron": 3.0, "plain": 1.0, "longer": 0.5}
    assert toxicity.first_witness("some plain text. an id iot here, moron", evidence) == "idiot"
    assert toxicity.first_witness("nothing at all", evidence) == "nothing" and toxicity.first_witness(None, evidence) == "" == toxicity.first_witness("a b 12", evidence)


def test_toxicity_of_long_texts_in_pieces(monkeypatch):
    """Pieces of any size have the units of the whole text: over cuts, wide gaps, words longer than a piece."""
    rng = random.Random(8)
    table = np.random.default_rng(4).normal(size=toxicity.LETTERS**4).astype(np.float32)
    model = toxicity.ToxicModel(np.arange(toxicity.LETTERS**4), table, 1.0, 0.0)
    texts = ["".join(rng.choice("abcde  .\n") for _ in range(n)) for n in (10, 900, 2000)] + ["x" * 700 + "abcd" * 200, None, ""]
    texts += ["".join(rng.choice(letters) for _ in range(1500)) for letters in ("abcd ", "ab     --12", "abc" * 30 + " ", "é日 b1", "a b\t\u2003c")]
    texts += ["ab" + " - " * 900 + "cd" + "." * 800 + "ef" + " " * 900 + "gh ij", "q w " * 3 + "z" * 900 + " e r t y" * 100]
    whole = toxicity.sliding(texts, table)
    for piece in (300, 37):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        decided = toxicity.Decided(model)
        assert len(toxicity.pieces(texts[2])) > 5 and np.allclose(decided.documents(texts), whole[0], atol=1e-3)
        assert [bool(u) for u in decided.units(texts)] == [bool(u) for u in whole[1]]


def plain_scores(rows, labels, marks=16):
    """Fit and score from the definitions: units, kernel, landmarks, witnesses and the logistic function, each spelled out."""

    def vector(u):
        v, square = defaultdict(float), 0.0
        for i in range(len(u)):
            for a, b, c, w in toxicity.OFFSETS:
                if i + c < len(u):
                    v[u[i] + u[i + a] + u[i + b] + u[i + c]] += w
                    square += w * w
        return {k: x / math.sqrt(square) for k, x in v.items()}

    def like(u, v):
        a, b = vector(u), vector(v)
        return sum(x * b.get(k, 0.0) for k, x in a.items())

    def units(text):
        for sentence in re.split(r"\n|(?<=[.!?])\s", (text or "").lower()):
            words = ["".join(filter(str.isalpha, w)) for w in sentence.split()]
            yield from (w for w in words if w)
            yield from toxicity.joined(words)
            yield from (w[i : i + n] for w in words if len(w) > toxicity.JOIN for n in toxicity.WINDOWS for i in range(len(w) - n + 1))

    texts, y = dict(rows), dict(labels)
    n = [sum(v == k for v in y.values()) for k in (0, 1)]
    count = [Counter(), Counter()]
    for i, v in labels:
        count[v].update({"".join(filter(str.isalpha, u)) for u in toxicity.units_of(texts[i].lower().split())})
    seen = sorted(u for u in {*count[0], *count[1]} if len(u) >= 4)
    odds = {u: math.log((count[1][u] + 0.5) / (n[1] + 1)) - math.log((count[0][u] + 0.5) / (n[0] + 1)) for u in seen}
    strong = sorted((-count[1][u] * odds[u], u) for u in seen if count[1][u] > 1 and odds[u] > 0)[: 8 * marks]
    plain = [u for _, u in sorted((-count[0][u], u) for u in seen if odds[u] < 0)[:marks]]
    witness = {i: toxicity.first_witness(texts[i], {u: -e for e, u in strong}) for i in y}
    landmarks = [u for _, u in strong[: marks // 2]] + plain[: marks // 2]
    value, vec = np.linalg.eigh(np.array([[like(a, b) for b in landmarks] for a in landmarks]))
    root = vec[:, value > 1e-6] / np.sqrt(value[value > 1e-6])
    sure = [u for _, u in strong if count[1][u] >= 5 and count[0][u] * n[1] < 0.02 * count[1][u] * n[0]]
    negatives = list(plain)

    def decided(u, beta):
        return sum(b * like(u, m) for b, m in zip(beta, landmarks)) if len(u) >= 4 else toxicity.LOWEST

    def best(text, beta, known):
        found = list(units(text))
        for u in found:
            if u not in known:
                known[u] = decided(u, beta)
        top = max((known[u] for u in found), default=toxicity.LOWEST)
        return top, next((u for u in found if known[u] == top and top > toxicity.LOWEST), "")

    for again in range(3):
        bad, good = [u for i, u in witness.items() if y[i] and u] + sure, [u for i, u in witness.items() if not y[i] and u] + negatives
        z = np.array([[like(u, m) for m in landmarks] for u in bad + good]) @ root
        side = np.array([1.0] * len(bad) + [-1.0] * len(good))
        w, bias = toxicity.fit_svm(z, side, np.where(side > 0, 1 / len(bad), 1 / len(good)) * len(side))
        beta, known = root @ w, {}
        if again < 2:
            negatives += [u for i, u in witness.items() if not y[i] and u]
            witness = {i: best(texts[i], beta, known)[1] for i in y}
    d = {i: best(t, beta, known)[0] for i, t in rows}
    x = np.array([[d[i] + bias, 1.0] for i, _ in labels])
    t = np.array([1 - 1 / (n[1] + 2) if v else 1 / (n[0] + 2) for _, v in labels])
    ab = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        ab -= np.clip(np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-4 * np.eye(2), x.T @ (p - t) + 1e-4 * ab), -5, 5)
    return d, {i: 1 / (1 + np.exp(-np.clip(ab[0] * (v + bias) + ab[1], -30, 30))) for i, v in d.items()}


def test_toxicity_equals_a_plain_fit_and_score(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LANDMARKS", 8)  # few, so that no two units of a text decide alike
    rows, labels = toxic_corpus(3, 60)
    rows = [(i, " ".join(t.split()[:22])) for i, t in rows] + [(900, "you id-iot"), (901, None), (902, "kalomi" * 6), (903, "a mo r on. vor")]
    got = {r["doc_id"]: r for r in toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(False)).collect()}
    decision, score = plain_scores(rows, labels, 8)
    assert {i: r["decision"] for i, r in got.items()} == pytest.approx(decision, abs=2e-3)
    assert {i: r["score"] for i, r in got.items()} == pytest.approx(score, abs=5e-3)
    assert {i: r["predicted"] for i, r in got.items()} == {i: int(v >= 0.3) for i, v in score.items()}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    for labels, want in (([], 0), ([(1, 1)], 1), ([(1, 0), (1, None)], 0)):
        got = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(False)).collect()
        assert [r["predicted"] for r in got] == [want] * 3


def test_kernel_equals_the_definition():
    def by_hand(s, t):
        def vector(u):
            v = defaultdict(float)
            for i in range(len(u)):
                for a, b, c, w in toxicity.OFFSETS:
                    if i + c < len(u):
                        v[u[i], u[i + a], u[i + b], u[i + c]] += w
            square = sum(w * w for i in range(len(u)) for *_, c, w in toxicity.OFFSETS if i + c < len(u))
            return {k: x / math.sqrt(square) for k, x in v.items()}

        a, b = vector(s), vector(t)
        return sum(x * b.get(k, 0.0) for k, x in a.items())

    units, marks = ["idiot", "ixdiot", "abcabcabc", "abc", "idiots"], ["idiot", "abcab"]
    got = toxicity.kernel(units, marks)
    assert np.allclose(got, [[by_hand(u, m) for m in marks] for u in units], atol=1e-6)
    assert got[0, 0] == pytest.approx(1.0, abs=0.2) and got[1, 0] > 0.2 and got[3, 0] == 0
