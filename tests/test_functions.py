import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalith.functions import parsing, scoring, trigram
from tests.definitions import best_extent


def value(spark, column, **row):
    types = {str: "string", int: "int", float: "double", bool: "boolean", type(None): "string"}
    schema = ", ".join(f"{k} {types[type(v)]}" for k, v in row.items()) or "x int"
    return spark.createDataFrame([tuple(row.values()) or (1,)], schema).select(column.alias("v")).first()["v"]


def test_similarity_matches_the_plain_definition(spark):
    rng = random.Random(1)
    words = ["small ring", "Red-Bolt 7", "", "é ü", "ring", "two words", "word", "aaa aaaa", None]
    rows = [(rng.choice(words), rng.choice(words)) for _ in range(60)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", trigram.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    for r in got:
        if r["a"] is None or r["b"] is None:
            continue
        a, b = set(trigram.python_trigrams(r["a"])), set(trigram.python_trigrams(r["b"]))
        assert r["s"] == pytest.approx(len(a & b) / len(a | b) if a | b else 0.0, abs=1e-6)


def test_word_similarity_examples():
    assert best_extent("word", "two words") == pytest.approx(0.8)
    assert best_extent("Entish Restoration", "</s>English Restoration") == pytest.approx(0.7368, abs=1e-4)
    assert best_extent("", "x") == best_extent("x", None) == 0.0


def test_best_extent_equals_all_extents():
    rng = random.Random(2)
    for _ in range(150):
        a, b = ("".join(rng.choice("ab c") for _ in range(rng.randint(0, 9))) for _ in range(2))
        t, line = set(trigram.python_trigrams(a)), trigram.python_trigrams(b)
        best = max((len(t & (e := set(line[i:j]))) / len(t | e) for i in range(len(line)) for j in range(i + 1, len(line) + 1)), default=0.0)
        assert best_extent(a, b) == pytest.approx(best)


@pytest.mark.parametrize(
    ("line", "number", "rarity", "set_code", "lang"),
    [
        ("U 0163 LTR . EN >CALDER MOORE", "163", "uncommon", "ltr", "en"),
        ("U 0163 U 016EN SCARER MOORE", "163", "uncommon", None, None),
        ("229/254 R THB • EN", "229", "rare", "thb", "en"),
        ("045/280 C STX-JP", "45", "common", "stx", "ja"),
        ("12/274 M", "12", "mythic", None, None),
    ],
)
def test_collector_line(spark, line, number, rarity, set_code, lang):
    got = value(spark, parsing.parse_collector_line(F.col("t")), t=line)
    assert (got["number"], got["rarity"], got["set_code"], got["lang"]) == (number, rarity, set_code, lang)


@pytest.mark.parametrize("line", ["", "CALDER MOORE", "TM & © 2023 The Publisher", None])
def test_no_collector_line(spark, line):
    assert value(spark, parsing.parse_collector_line(F.col("t")), t=line) is None


@pytest.mark.parametrize(("d", "score"), [(0, 1.0), (2, 1.0), (7, 0.5), (8, 0.4), (12, 0.0), (16, 0.0)])
def test_distance_score(spark, d, score):
    assert value(spark, scoring.distance_score(F.col("d")), d=d) == pytest.approx(score)


def test_orientation(spark):
    cases = [(4, 16, False), (8, 16, False), (6, 12, False), (16, 10, True), (14, 4, True), (14, 12, True), (None, 10, True), (12, 11, False), (16, None, False), (None, None, False)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a int, b int")
    assert [r[0] for r in df.select(scoring.should_flip(F.col("a"), F.col("b"))).collect()] == [c for *_, c in cases]


def test_type_lines(spark):
    cases = {
        "Legendary Creature — Elf Druid": ("Legendary", "Creature", "Elf Druid"),
        "basic SNOW Land - Forest": ("basic SNOW", "Land", "Forest"),
        "Instant": (None, "Instant", None),
        "Artifact —": (None, "Artifact", None),
        "Legendary": ("Legendary", "", None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", parsing.parse_type_line(F.col("t")).alias("p"))
    for r in df.collect():
        assert tuple(r["p"]) == cases[r["t"]]


def test_lenient_numbers_and_strict_dates(spark):
    df = spark.createDataFrame([("1,234.50", "2024-01-02"), ("x", "2024-13-01"), (None, "2024-1-1")], "n string, d string")
    got = df.select(parsing.lenient_decimal(F.col("n")).alias("n"), parsing.strict_date(F.col("d")).alias("d")).collect()
    assert [None if r["n"] is None else float(r["n"]) for r in got] == [1234.5, None, None]
    assert [r["d"] is None for r in got] == [False, True, True]


def test_fusion_is_monotone_and_bounded(spark):
    df = spark.range(11).select((F.col("id") / 10).alias("a")).crossJoin(spark.range(11).select((F.col("id") / 10).alias("b")))
    rows = {(r["a"], r["b"]): r["s"] for r in df.select("a", "b", scoring.fuse(F.col("a"), F.col("b")).alias("s")).collect()}
    assert all(0 <= s <= 1 for s in rows.values())
    assert all(rows[a, b] <= rows[a, c] + 1e-12 for a, b in rows for c in (b, 1.0) if c >= b)
    assert rows[0.0, 0.4] == pytest.approx(0.4)


def test_zone_order(spark):
    cases = [(0.3, 0.07, "name"), (0.3, 0.58, "type_line"), (0.9, 0.90, "power_toughness"), (0.1, 0.94, "bottom"), (0.5, 0.7, "rules_text"), (0.99, 0.99, "unknown")]
    df = spark.createDataFrame([(x, y) for x, y, _ in cases], "x double, y double")
    assert [r[0] for r in df.select(scoring.zone_of(F.col("x"), F.col("y"))).collect()] == [z for *_, z in cases]


def test_extents_of_many_pairs_at_once(spark, monkeypatch):
    """Arrow arrays of pairs against the plain definition, with repeated 3-grams, empty and null texts, and small steps."""
    from catalith.session import ship

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
    text = lambda: rng.choice([None, "", "...", " ".join(word() for _ in range(rng.randint(1, 9)))]) if rng.random() < 0.2 else " ".join(word() for _ in range(rng.randint(1, 9)))
    pairs = [(text(), text()) for _ in range(400)] + [("abcab", "abcab " * 60)]
    ship(spark)
    grams = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", trigram.target_grams(F.col("a")).alias("t"), trigram.line_grams(F.col("b")).alias("l"))
    got = grams.repartition(3, "i").select("i", trigram.word_similarity("t", "l").alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == pytest.approx([best_extent(a, b) for a, b in pairs], abs=1e-6)
    monkeypatch.setattr(trigram, "AT_ONCE", 10)
    number = lambda x: np.array([hash(g) for g in x], np.int64)
    sets, lines = [sorted(set(trigram.python_trigrams(a))) for a, _ in pairs], [trigram.python_trigrams(b) for _, b in pairs]
    flat = lambda x: (np.concatenate([number(g) for g in x]), np.cumsum([0, *map(len, x)]))
    assert trigram.best_extents(*flat(sets), *flat(lines)).tolist() == pytest.approx([best_extent(a, b) for a, b in pairs], abs=1e-6)
