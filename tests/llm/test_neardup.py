import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalith.llm import neardup


def sets_by_hand(texts, width):
    out = {}
    for i, t in texts.items():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        n = min(width, len(w))
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    return out


def components_by_hand(texts, width, percent):
    s = sets_by_hand(texts, width)
    up = {i: i for i in s}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(s), 2):
        both = len(s[a] & s[b])
        if both and 100 * both >= percent * (len(s[a]) + len(s[b]) - both):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(s[i]), root(i)) for i in s}


def corpus(seed, groups=12, copies=10, words=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(words)]
        for _ in range(copies):
            rate = rng.choice([0, 0, 0.01, 0.03, 0.06, 0.2])
            texts.append(" ".join(rng.choice(vocab) if rng.random() < rate else w for w in base))
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, docs, width, percent):
    texts = corpus(width) | {900: None, 901: "", 902: " \n", 903: "two words", 904: "TWO\twords", 905: "one", 906: "É a b", 907: "é a b", 908: "x " * 30000}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs(texts), width, percent).collect()}
    assert got == components_by_hand(texts, width, percent)


def test_one_large_group_in_several_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    texts = corpus(7, groups=2, copies=120, words=80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs(texts), 3, 85).collect()}
    assert got == components_by_hand(texts, 3, 85)


def test_repeated_rows_null_ids_and_empty_table(spark, docs):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (3, "a b c d e"), (7, "other words than those here"), (None, "a b c d e")]
    got = neardup.near_duplicates(docs(rows).withColumn("bands", F.lit("clash")), 3, 85).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 7, True)]
    assert neardup.near_duplicates(docs({}), 3, 85).count() == 0


def test_an_id_with_several_texts_is_one_node(spark, docs):
    a, b, c, d = ("red green blue one two", "sun moon star sky sea", "up down left right in", "oak elm ash fir yew")
    rows = [(2, b), (5, a), (5, b), (9, a), (5, None), (20, c), (20, d), (21, d), (22, c), (30, "alone here"), (30, ""), (31, "")]
    got = neardup.near_duplicates(docs(rows), 3, 85).collect()
    want = {2: 2, 5: 2, 9: 2, 20: 20, 21: 20, 22: 20, 30: 30, 31: 31}
    assert len(got) == len(rows) and all(r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == want[r["doc_id"]]) for r in got)
    # near copies of either text of an id
    long = lambda w: " ".join(f"{w}{i}" for i in range(100))
    rows = [(7, long("a")), (7, long("b")), (8, long("a") + " x"), (9, long("b") + " y"), (10, long("c"))]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs(rows), 3, 85).collect()}
    assert got == {7: 7, 8: 7, 9: 7, 10: 10}


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    for share in (0.5, 0.8, 0.95):
        n = int(2000 * 2 * share / (1 + share))
        other = np.sort(np.concatenate([base[:n], rng.integers(0, 2**63, 2000 - n, dtype=np.uint64)]))
        bits = neardup.packed_bits(neardup.minima([np.sort(base), other]))
        assert abs(neardup.estimated(bits[:1], bits[1:])[0, 0] - share) < 0.15
    assert 0.6 < neardup.least_estimate(0.85) < 0.85


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 60)] + [(70, 70)]
    found, _ = neardup.components(spark.createDataFrame(edges, "u long, v long"))
    got = {r["node"]: r["component"] for r in found.collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 1 for i in range(1, 60)}
