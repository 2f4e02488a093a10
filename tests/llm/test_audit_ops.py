"""Operators 11 to 13 against brute force and the library."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from catalith.llm import balls, bpe, counts, divergence, registry

PATH = public_tokenizers.path("word_bpe_49k.json")
NAN = float("nan")


def plain_kmeans(ids, x, k, rounds):
    order = sorted(range(len(ids)), key=lambda i: hashlib.sha256(f"1:{ids[i]}".encode()).hexdigest())[:k]
    c = x[order].copy()

    def assign():
        d = np.stack([((x - a) ** 2).sum(1) for a in c], 1)
        best = d.argmin(1)
        return best, d[np.arange(len(x)), best]

    for _ in range(rounds):
        best, _ = assign()
        for i in range(len(c)):
            if (best == i).any():
                c[i] = x[best == i].sum(0) // (best == i).sum()
    return *assign(), c


@pytest.mark.parametrize("kind", ["spread", "clustered", "copies"])
def test_balls_equal_the_plain_method(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.integers(-60, 60, (300, 6))
    if kind == "clustered":
        x = x // 8 + 400 * rng.integers(-3, 4, (12, 6))[rng.integers(0, 12, 300)]
    elif kind == "copies":
        x[50:250] = x[50]
    ids = list(range(1000, 1300))
    df = spark.createDataFrame([(i, v.tolist(), "z") for i, v in zip(ids, x)], "vec_id long, vector array<long>, cluster string").repartition(3)
    got = sorted(balls.ball_kmeans(df, 9, 3, 6).collect(), key=lambda r: r["vec_id"])
    best, d, c = plain_kmeans(ids, x, 9, 3)
    assert [(r["vec_id"], r["cluster"], r["distance"]) for r in got] == list(zip(ids, best.tolist(), d.tolist()))
    assert all(r["centroid"] == c[r["cluster"]].tolist() and r["inertia"] == d.sum() and r["cluster_inertia"] == d[best == r["cluster"]].sum() for r in got)


def test_balls_leave_out_what_the_radii_rule_out():
    rng = np.random.default_rng(1)
    own = rng.integers(0, 20, 4000)
    centres = rng.integers(-5000, 5000, (20, 8))
    x = centres[own] + rng.integers(-400, 400, (4000, 8))
    own[::50] = (own[::50] + 1) % 20
    far = [int(np.sqrt(((x[own == i] - centres[i]) ** 2).sum(1).max())) + 1 for i in range(20)]
    ball = balls.Balls(centres, tuple(far))
    best, least, tried = balls.reassign(x, own, ball, ball.neighbours())
    plain = balls.nearest(x, centres)
    assert best.tolist() == plain[0].tolist() and least.tolist() == plain[1].tolist()
    assert tried < 4000 * 19 / 10


def test_balls_ties_go_to_the_smaller_cluster():
    centres = np.array([[2, 0], [-2, 0], [0, 2], [0, -2], [9, 9]])
    ball = balls.Balls(centres, (4, 4, 4, 4, 4))
    for own in range(4):
        best, least, _ = balls.reassign(np.array([[0, 0]]), np.array([own]), ball, ball.neighbours())
        assert (best[0], least[0]) == (0, 4)


def test_balls_odd_rows(spark):
    rows = [(1, [1, 2]), (2, None), (3, [None, 1]), (4, [1]), (None, [5, 5]), (1, [1, 2]), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = sorted((str(r["vec_id"]), r["distance"]) for r in balls.ball_kmeans(df, 16, 3, 2).collect())
    assert got == [("1", 0), ("1", 0), ("None", 0)]
    assert balls.ball_kmeans(df.where("vec_id = 99"), 16, 3, 2).collect() == []
    raw = spark.createDataFrame([([NAN, 1.0],), ([float("inf"), 1.0],), ([1.0, 2.0],), (None,)], "v array<float>")
    assert raw.where(balls.usable(F.col("v"), 2)).count() == 1
    with pytest.raises(Exception, match="too long"):
        balls.ball_kmeans(spark.createDataFrame([(1, [1 << 40, 0])], "vec_id long, vector array<long>"), 2, 1, 2).collect()


def plain_divergence(rows, min_docs, most):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    found, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate(low) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang].add(source)
        found[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        count = {s: {t: found[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(count[s][t] for s in sources) for t in kept}

        def p(c):
            total = sum(c.values())
            return {t: 1 + 10**9 * (n + 5) // (total + 5 * len(kept)) for t, n in c.items()}

        q = p(whole)
        for s in sources:
            mine = p(count[s])
            pair = sorted(((-sum(abs(mine[t] - p(count[o])[t]) for t in kept), o.encode(), o) for o in sources if o != s))
            out += [(lang, s, "pair", o, -v, r) for r, (v, _, o) in enumerate(pair, 1)]
            term = sorted((q[t] - mine[t], t.encode(), t) for t in kept if count[s][t] and mine[t] > q[t])
            out += [(lang, s, "term", t, -v, r) for r, (v, _, t) in enumerate(term[:most], 1)]
    return sorted(out)


def documents(seed, n=150):
    rng = random.Random(seed)
    words = ["The", "and", "Éa", "éa", "x1y", "İs", "日本", "don't", "a\x00b", "­q", "z_w", "😀", "\x7fo"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(rng.choice(["en", "de", None, "de\x00"]), rng.choice(["s0", "s0", "s1", "S1", "é", None]), " ".join(rng.choice(words[: rng.randint(1, 33)]) for _ in range(rng.randint(0, 40)))) for _ in range(n)]
    return [*rows, *[("en", "s0", "the same text over and over")] * 9, ("fr", "s2", None), ("fr", "s3", ""), ("en", "only", "1 2 3"), ("es", "alone", "uno")]


@pytest.mark.parametrize("small", [False, True])
def test_divergence_equals_the_plain_definition(spark, small, monkeypatch):
    """Small: many shards, and tasks that combine and give on what they hold again and again."""
    if small:
        monkeypatch.setattr(divergence, "SHARD_ROWS", 7)
        monkeypatch.setattr(divergence, "HELD", 20)
    rows = documents(3)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, n long, term string").repartition(3)
    got = divergence.divergence(df, min_docs=6, most_terms=5)
    assert sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got.collect()) == plain_divergence(rows, 6, 5)


def test_divergence_of_nothing_and_of_rare_terms(spark):
    empty = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.divergence(empty).collect() == []
    rare = spark.createDataFrame([("en", "a", "b"), ("en", "c", "d"), ("en", "e", None)], "lang string, source string, text string")
    assert {(r["source"], r["item"], r["value"], r["part"]) for r in divergence.divergence(rare).collect()} == {(s, i, 0, "pair") for s in "ace" for i in "ace" if s != i}


def test_divergence_of_a_very_long_text(spark):
    text = " ".join(f"{'ab'[i % 2]}{chr(97 + i % 26)} Common" for i in range(300_000))
    rows = [("en", "long", text), *[("en", "short", "common words")] * 30]
    got = divergence.divergence(spark.createDataFrame(rows, "lang string, source string, text string"))
    assert sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got.collect()) == plain_divergence(rows, 30, 50)


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_whole_tokens_are_proven():
    lib = library()
    whole = sorted(counts.whole_tokens(PATH))
    assert len(whole) > 30_000
    assert all(len(e.ids) == 1 for e in lib.encode_batch(whole, add_special_tokens=False))
    # what the proof leaves out is no single token or no pre-token
    enc = bpe.PairIndexEncoder(PATH)
    left = [s.removesuffix(enc.suffix) for s in enc.ids if s.endswith(enc.suffix) and s.isascii()]
    left = [s for s in left if s and s not in counts.whole_tokens(PATH)]
    assert all(len(e.ids) != 1 or e.tokens != [s + enc.suffix] for s, e in zip(left, lib.encode_batch(left, add_special_tokens=False)))


@pytest.mark.parametrize("remember", [counts.REMEMBER, 40])
def test_counts_equal_the_library(spark, docs, monkeypatch, remember):
    from tests.llm.test_text_ops import ODD, random_texts

    lib = library()
    texts = [*ODD, *random_texts(300, 4), "word " * 3000, "x" * 30_000, "<|endoftext|>" * 3, "a<|startoftext|>b \x00c", None, "don't DON'T I'll", "naïve café", "ﬁ ǅ", "\x0b\x0c\x1c"]
    mine = counts.WholeTokenCounter(PATH, counts.whole_tokens(PATH), remember=remember)
    want = [len(lib.encode(t or "", add_special_tokens=False).ids) for t in texts]
    monkeypatch.setattr(counts, "GROUP_CHARS", 500)
    monkeypatch.setattr(bpe, "PIECE_CHARS", 100)
    assert mine.count_many(texts) == want and mine.direct and mine.merged
    if remember == 40:
        return
    rows = counts.token_counts(docs(list(enumerate(texts))), PATH, limit=2048).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows} == {i: (len((t or "").encode()), n, n > 2048) for i, (t, n) in enumerate(zip(texts, want))}


def test_counts_of_odd_tables(spark):
    got = counts.token_counts(spark.createDataFrame([(None, "a b", 1), (3, "a b", 2), (3, "a b", 2), (4, None, 3)], "doc_id long, text string, n_tokens long"), PATH)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_bytes"], r["over_limit"]) for r in got.collect()) == [("3", 2, 3, False), ("3", 2, 3, False), ("4", 0, 0, False), ("None", 2, 3, False)]
    assert counts.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_queries_over_the_small_tables(spark):
    lib = library()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_tokens"], r["over_limit"]) for r in registry.op13_token_counts(spark, "/root/testdata/sf0.001").collect()}
    want = {i: len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in docs.items()}
    assert got == {i: (n, n > 2048) for i, n in want.items()}
