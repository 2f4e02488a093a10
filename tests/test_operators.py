import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalith.functions import scoring
from catalith.operators import documents, hamming, lookups, prices, resolve, search
from catalith.sources import catalogue, store
from tests.definitions import best_extent

OBSERVED = "seq long, printing_id string, eur decimal(12,2), eur_foil decimal(12,2)"
LATEST = "printing_id string, eur decimal(12,2), eur_foil decimal(12,2), updated_at timestamp"
POINTS = "printing_id string, observed_on date, eur decimal(12,2), eur_foil decimal(12,2), source string"


def ingest(spark, *days):
    """days: (date, [eur, ...]) of one key in arrival order."""
    from decimal import Decimal

    latest, points = spark.createDataFrame([], LATEST), spark.createDataFrame([], POINTS)
    for day, values in days:
        rows = [(i, "p1", None if v is None else Decimal(v), None) for i, v in enumerate(values)]
        batch = spark.createDataFrame(rows, OBSERVED)
        latest, points, _ = prices.ingest_batch(batch, latest, points, F.lit(day), F.lit("test"), F.lit("2026-06-20 00:00:00"))
    return latest.collect(), sorted((str(r["observed_on"]), r["eur"] and float(r["eur"])) for r in points.collect())


@pytest.mark.parametrize(
    ("days", "points", "last"),
    [
        ([("2026-06-20", ["1.50"])], [("2026-06-20", 1.5)], 1.5),
        ([("2026-06-20", ["1.50"]), ("2026-06-21", ["1.50"])], [("2026-06-20", 1.5)], 1.5),
        ([("2026-06-20", ["1.50"]), ("2026-06-21", ["2.00"])], [("2026-06-20", 1.5), ("2026-06-21", 2.0)], 2.0),
        ([("2026-06-20", ["1.50", "1.50"])], [("2026-06-20", 1.5)], 1.5),
        ([("2026-06-20", ["1.50"]), ("2026-06-20", ["1.75"])], [("2026-06-20", 1.75)], 1.75),
        ([("2026-06-20", [None])], [], None),
        ([("2026-06-20", ["1.50"]), ("2026-06-21", [None])], [("2026-06-20", 1.5), ("2026-06-21", None)], None),
    ],
)
def test_store_on_change(spark, days, points, last):
    latest, got = ingest(spark, *days)
    assert got == points
    assert [r["eur"] and float(r["eur"]) for r in latest] == ([last] if points else [])


def test_history_floor_and_order(spark):
    rows = [("p", dt.date(2026, 6, 21), None, None, "t"), ("p", dt.date(2026, 6, 19), None, None, "t"), ("p", dt.date(2025, 1, 1), None, None, "t")]
    got = prices.history(spark.createDataFrame(rows, POINTS), F.lit("2026-06-22").cast("date"), 365).collect()
    assert [str(r["observed_on"]) for r in got] == ["2026-06-19", "2026-06-21"]


def printings(spark):
    cols = "id string, oracle_id string, name string, set_code string, collector_number string, rarity string, lang string, type_line_full string, rules_text string, oracle_text string, power string, toughness string, cmc float, color_identity array<string>, image_object_key string, is_foil boolean"
    card = lambda i, o, n, s, c, r, t: (i, o, n, s, c, r, "en", t, None, None, None, None, 1.0, ["G"], None, False)
    rows = [card("test-entish-ltr-163", "o1", "Entish Restoration", "ltr", "163", "uncommon", "Instant"), card("test-meldweb-one-59", "o2", "Meldweb Curator", "one", "59", "common", "Artifact Creature — Phyrexian Wizard")]
    rows += [card(f"test-instant-{i}", f"f{i}", f"Filler Spell {i}", "tst", str(200 + i), "common", "Instant") for i in range(60)]
    return spark.createDataFrame(rows, cols)


def scan(spark, bottom, name="</s>English Restoration", symbol=None):
    row = ("s", name, "Instant", None, None, bottom, 0.52, 0.66, 0.0, 0.0, 0.35, symbol)
    return spark.createDataFrame([row], "scan_id string, name string, type_line string, rules_text string, power_toughness string, bottom string, name_conf double, type_line_conf double, rules_text_conf double, power_toughness_conf double, bottom_conf double, symbol_set string")


def scored(spark, bottom, seeds=(), **kw):
    s = spark.createDataFrame([("s", x) for x in seeds], "scan_id string, id string")
    return {r["id"]: r for r in resolve.zone_scores(scan(spark, bottom, **kw), printings(spark), s).collect()}


def test_zone_scorer_number_and_rarity(spark):
    got = scored(spark, "U 0163 U 016EN SCARER MOORE", ["test-meldweb-one-59"])
    e = got["test-entish-ltr-163"]
    assert e["name_score"] > 0.3 and e["type_line_score"] == 1.0 and e["bottom_score"] == 0.6 and e["ocr_score"] > 0.6
    assert got["test-meldweb-one-59"]["ocr_score"] == 0 and not any(k.startswith("test-instant") for k in got)


def test_zone_scorer_set_text_and_pool_number(spark):
    assert scored(spark, "U 0163 LTR . EN >CALDER MOORE")["test-entish-ltr-163"]["bottom_score"] == 1.0
    only = scored(spark, "U 0163 LTR . EN", name="zzzz")
    assert list(only) == ["test-entish-ltr-163"]
    got = scored(spark, "163/281", ["test-meldweb-one-59"])
    assert got["test-entish-ltr-163"]["bottom_score"] == 0.3 and got["test-meldweb-one-59"]["bottom_score"] == 0.0


def test_symbol_tiers(spark):
    assert scored(spark, "U 0163 LTR . EN", symbol="ltr")["test-entish-ltr-163"]["bottom_score"] == 1.0
    assert scored(spark, "U 0163 ONE . EN", symbol="ltr")["test-entish-ltr-163"]["bottom_score"] == 0.9


def test_tiers_are_told_before_their_printings_are_looked_up(spark):
    cards = spark.createDataFrame([(f"c{n:03}", "s01" if n % 2 else "s02", "7", "en", "common") for n in range(140)] + [("other", "s03", "8", "en", "rare")], "id string, set_code string, collector_number string, lang string, rarity string")
    lines = [("both", "C 0007 S01 . EN", "S01"), ("symbol", "C 0007 S02 . EN", "s01"), ("text", "C 0007 S02 . EN", None), ("french", "C 0007 S01 . FR", None), ("pool", "C 0007", None), ("far", "C 0007 S09 . EN", None), ("far", "C 0007 S09 . EN", None), ("rare", "R 0007", "s03")]
    scans, asked = spark.createDataFrame(lines, "scan_id string, bottom string, symbol_set string"), []

    def pool(left):
        asked.append(sorted(r["scan_id"] for r in left.collect()))
        return left.select("scan_id").distinct().join(cards.select("id")).where("scan_id = 'pool' and id > 'c100' or scan_id = 'rare'")

    rows = resolve.collector_candidates(scans, cards, pool).collect()
    assert asked == [["far", "far", "french", "pool", "rare"]]  # scans that a set decides draw no pool
    got = {}
    for r in rows:
        got.setdefault((r["scan_id"], r["tier"], r["score"]), []).append(r["id"])
    ids = lambda low, odd: [f"c{n:03}" for n in range(low, 140) if odd is None or n % 2 == odd]
    first = ids(0, None)[:50]
    assert {k: sorted(v) for k, v in got.items()} == {
        ("both", 0, 1.0): ids(0, 1), ("symbol", 1, 0.9): ids(0, 1), ("text", 2, 1.0): ids(0, 0), ("french", 4, 0.6): first, ("pool", 3, 0.6): ids(101, None), ("far", 4, 0.6): sorted(first[:25] * 2),
    }


def test_distinct_pairs_of_texts_are_scored_once(spark, monkeypatch):
    lines = [("a", "goblin ring"), ("b", "goblin ring"), ("c", None), ("d", " "), ("e", "old plate")]
    rows = spark.createDataFrame([(s, n, line, c) for s, line in lines for n, c in enumerate(["goblin king", "goblin king", None, "plate"])], "scan_id string, id int, name string, c_name string")
    seen, write = [], resolve.written
    monkeypatch.setattr(resolve, "written", lambda df: seen.append(df.count()) or write(df))
    got = resolve.with_text_score(rows, "c_name", "name", F.coalesce(F.trim("name"), F.lit("")) != "", resolve.word_similarity("__c", "__l"), "said").collect()
    assert seen == [4] and len(got) == 20  # two lines and two names, however many rows show them
    want = lambda r: best_extent(r["c_name"], r["name"]) if (r["name"] or " ") != " " and r["c_name"] else None
    assert all((r["said"] is None) == (want(r) is None) and abs((r["said"] or 0) - (want(r) or 0)) < 1e-6 for r in got)


def test_fusion_and_class(spark):
    zones = spark.createDataFrame([("s", "right", 0.58)], "scan_id string, id string, ocr_score double")
    hits = spark.createDataFrame([("s", "noise", 8)], "scan_id string, id string, distance int")
    got = {r["id"]: r["score"] for r in resolve.fused(zones, hits).collect()}
    assert got["noise"] == pytest.approx(0.4) and got["right"] > got["noise"]
    rows = resolve.zone_scores(scan(spark, "U 0163 LTR . EN"), printings(spark))
    none = spark.createDataFrame([], "scan_id string, id string, distance int")
    weights = spark.createDataFrame([("test-entish-ltr-163", 1.0)], "id string, weight double")
    done = resolve.classified(resolve.ranked(resolve.fused(rows, none), weights), scan(spark, "")).first()
    assert done["id"] == "test-entish-ltr-163" and done["confidence"] in ("Medium", "High")


def test_search_pages(spark):
    sets = spark.createDataFrame([("ltr", "L", "expansion", dt.date(2023, 1, 1))], "code string, name string, set_type string, released_at date")
    p = printings(spark)
    found = search.search(p, sets, search.SearchRequest(q="  filler SPELL 7 ", take=3)).collect()
    assert found[0]["name"] == "Filler Spell 7" and len(found) == 3
    assert search.search_total(p, search.SearchRequest(q="filler spell")).first()["total"] == 60
    assert search.search(p, sets, search.SearchRequest(set_code="LTR")).first()["printing_count"] == 1
    r = search.SearchRequest(sort="released_at", take=500, colors="g, w").canonical()
    assert r.descending and r.take == 100 and r.colors == ("G", "W")


def test_hamming_chunks_and_tiles_equal_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = base + [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in base] + [x ^ (rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64)) for x in base] + base[:5]
    rows = [(i, x - 2**64 if x >= 2**63 else x) for i, x in enumerate(values)]
    h = spark.createDataFrame(rows, "id long, hash long").repartition(3)
    every = sorted((i, j, (x ^ y).bit_count()) for i, x in enumerate(values) for j, y in enumerate(values))
    for radius in (0, 3, 9, 16, 64):
        assert sorted(map(tuple, hamming.within(h, h, radius).collect())) == [e for e in every if e[2] <= radius]
    assert hamming.narrow(3) and not hamming.narrow(16)
    for radius, k in ((3, 2), (20, 4)):
        got = sorted((r["query_id"], r["rank"], r["id"], r["distance"]) for r in hamming.nearest(h.where("id % 3 = 0"), h, radius, k).collect())
        want = []
        for q in range(0, len(values), 3):
            best = sorted((d, j) for i, j, d in every if i == q and d <= radius)[:k]
            want += [(q, n, j, d) for n, (d, j) in enumerate(best, 1)]
        assert got == want
    assert hamming.within(h.limit(0), h, 16).count() == 0 == hamming.nearest(h, h.limit(0), 16, 3).count()


def test_hamming_tiles_give_no_row_beyond_their_hits():
    rng = np.random.default_rng(3)
    q, h = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (50, 3000))
    i, j, d = hamming.hits_of(q, h, 24, np.arange(3000), 5)
    assert len(i) <= 250 and (np.bincount(i, minlength=50) <= 5).all() and (d <= 24).all() and (np.bitwise_count(q[i] ^ h[j]) == d).all()


@pytest.mark.parametrize(("bits", "radius"), [(31, 16), (62, 14)])
def test_hamming_top_k_of_a_tile_is_bounded_before_it_is_sorted(monkeypatch, bits, radius):
    rng = np.random.default_rng(4)
    q, h = (rng.integers(0, 2**bits, n, dtype=np.uint64) for n in (70, 3001))
    h[2000:2600] = h[:600]
    q[:60] = h[:60]
    ids = np.array([str(i) for i in rng.permutation(len(h))])
    distance = np.bitwise_count(q[:, None] ^ h[None, :])
    want = [(i, int(j), int(distance[i, j])) for i in range(len(q)) for j in np.lexsort((ids, distance[i]))[:6] if distance[i, j] <= radius]
    sizes, lexsort = [], np.lexsort
    monkeypatch.setattr(hamming.np, "lexsort", lambda keys: sizes.append(len(keys[0])) or lexsort(keys))
    assert sorted(zip(*(x.tolist() for x in hamming.hits_of(q, h, radius, ids, 6)), strict=True)) == sorted(want)
    assert sum(sizes) < 0.15 * len(q) * len(h)  # of 31 bits more than half of all pairs lie within 16
    every = sorted(zip(*(x.tolist() for x in hamming.hits_of(q, h, radius, ids, None)), strict=True))
    assert every == sorted((int(i), int(j), int(distance[i, j])) for i, j in zip(*np.nonzero(distance <= radius), strict=True))


@pytest.mark.parametrize(("bits", "copies"), [(64, 1), (62, 40), (20, 1)])
def test_hamming_tiles_look_at_near_quarters_only(monkeypatch, bits, copies):
    rng = np.random.default_rng(5)
    h = np.repeat(rng.integers(0, 2**bits, 30_000 // copies, dtype=np.uint64), copies)
    q = np.concatenate([h[:40] ^ np.uint64(5), h[-20:] ^ np.uint64(2**13 - 1), rng.integers(0, 2**bits, 30, dtype=np.uint64)])
    ids = rng.permutation(len(h))
    distance = np.bitwise_count(q[:, None] ^ h[None, :])
    looked, below = [], hamming._Counter.below
    monkeypatch.setattr(hamming._Counter, "below", lambda self, q, h, bound: looked.append(len(q) * len(h)) or below(self, q, h, bound))
    monkeypatch.setattr(hamming, "PLACE_COST", 1)
    monkeypatch.setattr(hamming, "PLACES", 300)  # so that places that many rows share are looked at in parts
    every = sorted(zip(*(x.tolist() for x in hamming.hits_of(q, h, 12, ids, None)), strict=True))
    assert every == sorted((int(i), int(j), int(distance[i, j])) for i, j in zip(*np.nonzero(distance <= 12), strict=True))
    want = [(i, int(j), int(distance[i, j])) for i in range(len(q)) for j in np.lexsort((ids, distance[i]))[:7] if distance[i, j] <= 12]
    assert sorted(zip(*(x.tolist() for x in hamming.hits_of(q, h, 12, ids, 7)), strict=True)) == sorted(want)
    assert bool(looked) == (bits == 20)  # rows that share all but one of their quarters are better looked at in turn


def test_hamming_top_k_of_a_wide_radius_looks_at_few_pairs(monkeypatch):
    rng = np.random.default_rng(8)
    h, q = (rng.integers(0, 2**62, n, dtype=np.uint64) for n in (200_000, 4096))
    q[:100] = h[:100] ^ np.uint64(1)
    looked, below = [], hamming._Counter.below
    monkeypatch.setattr(hamming._Counter, "below", lambda self, q, h, bound: looked.append(len(q) * len(h)) or below(self, q, h, bound))
    ids = rng.permutation(len(h))
    i, j, d = hamming.hits_of(q, h, 16, ids, 3)
    assert sum(looked) < 0.2 * len(q) * len(h)
    for n in range(0, 4096, 128):
        distance = np.bitwise_count(q[n] ^ h)
        assert sorted(zip(d[i == n], ids[j[i == n]], strict=True)) == [(distance[x], ids[x]) for x in np.lexsort((ids, distance))[:3] if distance[x] <= 16]


@pytest.mark.parametrize(("bits", "copies", "radius"), [(62, 1, 16), (60, 30, 13), (34, 3, 14), (62, 5, 2)])
def test_hamming_tables_hold_few_hits_and_lose_none(monkeypatch, bits, copies, radius):
    rng = np.random.default_rng(9)
    h = np.repeat(rng.integers(0, 2**bits, 12_000 // copies, dtype=np.uint64), copies)
    q = np.concatenate([h[:50] ^ np.uint64(3), rng.integers(0, 2**bits, 50, dtype=np.uint64)])
    ids = rng.permutation(len(h))
    distance = np.bitwise_count(q[:, None] ^ h[None, :])
    monkeypatch.setattr(hamming, "PLACE_COST", 0)
    monkeypatch.setattr(hamming, "HELD", 200)  # so that hits beyond the k nearest go again and again
    want = [(i, int(j), int(distance[i, j])) for i in range(len(q)) for j in np.lexsort((ids, distance[i]))[:7] if distance[i, j] <= radius]
    assert sorted(zip(*(x.tolist() for x in hamming.hits_of(q, h, radius, ids, 7)), strict=True)) == sorted(want)
    every = sorted(zip(*(x.tolist() for x in hamming.hits_of(q, h, radius, ids, None)), strict=True))
    assert every == sorted((int(i), int(j), int(distance[i, j])) for i, j in zip(*np.nonzero(distance <= radius), strict=True))


def test_scan_chain_searches_the_other_side_only_where_it_can_matter(spark, tmp_path, monkeypatch):
    from catalith.operators import scan
    from catalith.plans.state import scan_inputs

    rows = [(i, "small ring", "Brand#1", "STANDARD", i % 7) for i in range(1, 49)]
    spark.createDataFrame(rows, "p_partkey int, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    asked, plain = [], scan.sided_hits
    monkeypatch.setattr(scan, "sided_hits", lambda hashes, column, *rest: asked.append((column, hashes)) or plain(hashes, column, *rest))
    regions, hashes, cards, codes, weights = scan_inputs(spark, str(tmp_path))
    _, outcome = scan.scan_chain(regions, hashes, cards, codes, weights)
    assert {int(r["scan_id"]) for r in outcome.where("flipped").collect()} == {8, 20, 32, 44}
    whole = [sorted(int(r["scan_id"]) for r in h.where("full_hash is not null and side = 1").collect()) for c, h in asked if c == "full_hash"]
    assert [x for x in whole if x] == [[8, 20, 32, 44]]  # those that came upside down; the others are near as they came


def test_word_matches_equal_the_plain_definition(spark):
    from catalith.functions.trigram import word_matches
    from tests.definitions import best_extent

    rng = random.Random(4)
    words = ["small", "ring", "green", "bolt", "smal", "rings", "x", "the", "thing"]
    names = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(25)})
    lines = sorted({" ".join(rng.choice(words) + rng.choice(["", "s", "q"]) for _ in range(rng.randint(0, 6))) for _ in range(40)} | {"zzz"})
    for cutoff in (0.3, 0.6):
        found = word_matches(spark.createDataFrame([(n, n) for n in names], "i string, n string"), spark.createDataFrame([(x, x) for x in lines], "k string, l string"), "i", "n", "k", "l", cutoff)
        want = {(n, x): best_extent(n, x) for n in names for x in lines}
        got = {(r["i"], r["k"]): r["score"] for r in found.collect()}
        # scores are 32-bit: one right at the cutoff may fall to either side
        assert {p: s for p, s in got.items() if s > cutoff + 1e-6} == {p: pytest.approx(s, abs=1e-6) for p, s in want.items() if s > cutoff + 1e-6}
        assert all(want[p] >= cutoff - 1e-6 for p in got)


def test_confidence_by_the_first_row_that_has_a_printing(spark):
    zones = [f"{z}_{x}" for z in resolve.ZONES for x in ("score", "conf")]
    row = lambda scan, i, rank, score, zone: (scan, i, rank, score, *[zone] * 10, zone)
    rows = spark.createDataFrame([row("a", "gone", 1, 0.9, 0.1), row("a", "x", 2, 0.5, 0.9), row("b", "x", 1, 0.9, 0.9), row("c", "gone", 1, 0.9, 0.9)], ["scan_id", "id", "rank", "combined", *zones, "ocr_score"])
    scans, cards = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "scan_id string"), spark.createDataFrame([("x",), ("x",)], "id string")
    got = {r["scan_id"]: (r["id"], r["confidence"]) for r in resolve.classified(rows, scans, cards).collect()}
    assert got == {"a": ("gone", "High"), "b": ("x", "High"), "c": ("gone", "Low"), "d": (None, "Low")}
    low = F.lit(0.9), [F.lit(0.9)] * 2, [F.lit(0.1)] * 2, F.lit(0.9)
    assert scans.select(scoring.confidence_class(*low), scoring.confidence_class(*low, least_read=0)).first()[:] == ("Medium", "High")


def test_numbers_in_a_total_order(spark):
    df = spark.range(0, 1000, 1, 7).select(F.pmod(F.xxhash64("id"), F.lit(10_000)).alias("v"), "id")
    got = lookups.numbered(df, [F.desc("v"), F.asc("id")], "n").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, 1001)) and [(r["v"], -r["id"]) for r in got] == sorted(((r["v"], -r["id"]) for r in got), reverse=True)


def test_documents(spark):
    card = "struct<instance_id:string,printing_id:string,is_foil:boolean,language:string>"
    df = spark.createDataFrame([([("a", "p", True, "en"), ("b", "p", False, "en"), ("c", "q", False, "de")], [("d", "p", False, "en")])], f"x array<{card}>, y array<{card}>")
    rest, into, missing = documents.moved(F.col("x"), F.col("y"), F.array(F.lit("a"), F.lit("zz"), F.lit("a")))
    got = df.select(rest.alias("r"), into.alias("i"), missing.alias("m"), documents.clashes(F.col("x"), F.lit("p"), F.lit(True), F.lit("EN")).alias("clash")).first()
    assert sorted(c["instance_id"] for c in got["r"] + got["i"]) == ["a", "b", "c", "d"] and got["m"] == 1 and got["clash"]


def test_retry_rule(spark):
    rows = [(True, 0.5, 0.5, 2, 2, False, True), (True, 0.1, 0.9, 3, 2, False, False), (False, 0.5, 0.5, 1, 3, True, True), (False, 0.5, 0.3, 1, 3, True, False), (False, 0.4, 0.5, 3, 1, False, True)]
    df = spark.createDataFrame([r[:6] for r in rows], "d boolean, f double, o double, fc int, oc int, m boolean")
    assert [r[0] for r in df.select(resolve.accept_retry(*map(F.col, df.columns))).collect()] == [r[6] for r in rows]


def test_upserts_and_batches(spark, tmp_path):
    schema = "id int, name string, hash int"
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], schema)
    new = spark.createDataFrame([(2, "B", None), (3, "C", 7)], schema)
    want = [(1, "a", 5), (2, "B", 6), (3, "C", 7)]
    assert sorted(map(tuple, store.upsert(old, new, ["id"], preserve=["hash"]).collect())) == want
    path = str(tmp_path / "t")
    for number, batch in ((0, old), (1, new), (1, new), (0, old)):
        store.append(batch, path, number)
    assert sorted(map(tuple, store.current(spark, path, schema, ["id"], ["hash"]).collect())) == want
    assert sorted(map(tuple, store.current(spark, path, schema, ["id"], before=1).collect())) == [(1, "a", 5), (2, "b", 6)]


def test_a_failed_run_leaves_what_was_committed(spark, tmp_path):
    path = str(tmp_path / "index")
    store.rebuild_index(spark.createDataFrame([(1, 5)], "id int, hash long"), path, 1)
    broken = spark.createDataFrame([(2, 6)], "id int, hash long").withColumn("hash", F.raise_error(F.lit("broken")).cast("long"))
    report = store.reported(lambda: store.rebuild_index(broken, path, 2) or {})
    assert report["status"] == "failed" and "broken" in report["error"]
    assert [tuple(r) for r in store.live_index(spark, path).collect()] == [(1, 5)]
    assert store.reported(lambda: store.rebuild_index(spark.createDataFrame([(3, 7)], "id int, hash long"), path, 3) or {"total": 1}) == {"status": "completed", "total": 1}
    assert [tuple(r) for r in store.live_index(spark, path).collect()] == [(3, 7)]


def test_bulk_files(spark, tmp_path):
    (tmp_path / "bulk.json").write_text('{"data": [{"type": "other", "download_uri": "x"}, {"type": "default_cards", "download_uri": "y"}]}')
    (tmp_path / "sets.json").write_text('{"data": [{"code": "ltr", "name": "L", "released_at": "2023-06-23"}, {"code": "x", "released_at": "2023-6-1"}]}')
    (tmp_path / "cards.json").write_text('[{"id": "1", "name": "A"}, null, {"id": "2"}]')
    (tmp_path / "a.png").write_bytes(b"123")
    assert catalogue.bulk_entry(spark, str(tmp_path / "bulk.json")) == "y"
    with pytest.raises(ValueError):
        catalogue.bulk_entry(spark, str(tmp_path / "bulk.json"), "none")
    assert [str(r["released_at"]) for r in catalogue.read_sets(spark, str(tmp_path / "sets.json")).orderBy("code").collect()] == ["2023-06-23", "None"]
    assert sorted(r["id"] for r in catalogue.read_cards(spark, str(tmp_path / "cards.json"), lines=False).collect()) == ["1", "2"]
    assert catalogue.read_images(spark, str(tmp_path / "a.png")).first()["content"] == b"123"


def test_raw_cards(spark, tmp_path):
    (tmp_path / "c.json").write_text(
        '{"id":"1","name":"A // B","set":"X","layout":"transform","lang":"de","type_line":"Front // Back","card_faces":[{"name":"A","type_line":"Legendary Creature — Elf","printed_type_line":"Legendary Kreatur — Elf","oracle_text":"t"},{"name":"B"}],"prices":{"eur":"1.555","eur_foil":"x"},"cmc":2}\n'
        '{"id":"2","digital":true}\n'
    )
    raw = catalogue.read_cards(spark, str(tmp_path / "c.json"))
    p = catalogue.printings_of(raw, F.lit("2026-01-01 00:00:00")).collect()
    assert len(p) == 1 and p[0]["oracle_id"] == "" and p[0]["supertype"] == "Legendary" and p[0]["type"] == "Kreatur" and len(p[0]["faces"]) == 2
    o = catalogue.observations_of(raw, F.lit(1)).where("printing_id = '1'").first()
    assert float(o["eur"]) == 1.56 and o["eur_foil"] is None
    assert lookups.with_set_weights(spark.createDataFrame([("1", "zz")], "id string, set_code string"), spark.createDataFrame([], "code string, set_type string"), catalogue.seed_weights(spark)).first()["weight"] == 0.5


def test_ocr_regions(spark):
    body = '{"width": 10, "regions": [{"text": "a", "box": {"x_min": 0, "y_min": 0, "x_max": 1, "y_max": 1}, "quad": [1, 2]}, {"text": "no box"}]}'
    got = catalogue.read_regions(spark.createDataFrame([("s", body)], "scan_id string, body string")).collect()
    assert len(got) == 1 and got[0]["image_height"] == 0 and got[0]["quad"] is None


def test_scan_chain_finds_every_card(spark, tmp_path):
    from catalith.plans.state import scan_chain

    names = ["small ring", "green bolt", "shiny plate"]
    rows = [(i, names[i % 3], "Brand#1", "STANDARD", i % 7) for i in range(1, 97)]
    spark.createDataFrame(rows, "p_partkey int, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {int(r["scan_id"]): r for r in scan_chain(spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(1, 97))
    # sets of the prior 1.0 are sure, but for worn names without a picture's hash; for those of 0.1 a card of the same name in a likelier set comes first
    assert all((r["id"], r["confidence"]) == (str(i), "Medium" if i % 15 == 0 else "High") for i, r in got.items() if i % 2 == 0), got
    assert all(int(r["id"]) % 2 == 0 and names[int(r["id"]) % 3] == names[i % 3] and r["confidence"] != "High" for i, r in got.items() if i % 2)
    # upside down: with whole-image hashes the probe turns the scan before it is read; without, the second reading does
    assert {i for i, r in got.items() if r["flipped"]} == {i for i in got if i % 4 == 0 and i % 3 == 2}
    assert {i for i, r in got.items() if r["turned"]} == {i for i in got if i % 4 == 0 and i % 3 != 2}
    assert all(r["side"] == (i % 4 == 0) for i, r in got.items())
    # a turned scan is fused with the hits of its turned picture, not with those of the first reading
    assert all(r["hash_distance"] == {0: None, 1: 2, 2: 1}[i % 3] for i, r in got.items())


SIDES = "scan_id long, side int, best double, cover int, down boolean, bare boolean"


def test_retry_chooses_a_whole_side(spark):
    from catalith.operators import scan

    first = [
        (1, 0, 0.9, 4, False, False),  # good: not read again
        (2, 0, 0.3, 2, False, False),  # weak, the other is better
        (3, 0, 0.3, 2, False, False),  # weak, the other is no better
        (4, 1, 0.9, 3, True, False),  # upside down, the other as good in both
        (5, 0, 0.2, 3, True, False),  # upside down, the other refused by the gate
        (6, 0, 1.0, 2, False, True),  # without structure, the other shows more zones and reads well enough
        (7, 0, 1.0, 2, False, True),  # the same, but reads badly
        (8, 0, 0.1, 0, False, True),  # nothing on the other side
    ]
    other = [(2, 0.5, 1), (3, 0.3, 5), (4, 0.9, 3), (5, 1.0, 2), (6, 0.4, 3), (7, 0.39, 3), (1, 1.0, 5)]
    sides = scan.chosen_sides(spark.createDataFrame(first, SIDES), spark.createDataFrame(other, "scan_id long, best double, cover int"))
    got = {r["scan_id"]: (r["side"], r["retried"], r["turned"]) for r in sides.collect()}
    assert got == {1: (0, False, False), 2: (1, True, True), 3: (0, True, False), 4: (0, True, True), 5: (0, True, False), 6: (1, True, True), 7: (0, True, False), 8: (0, True, False)}
    a, b = (spark.createDataFrame([(i, side) for i in range(1, 9)], "scan_id long, id string") for side in ("first", "other"))
    assert {r["scan_id"] for r in scan.with_choice(a, b, sides).where("id = 'other'").collect()} == {2, 4, 6}


@pytest.mark.parametrize(("mode", "side"), [("flip", 1), ("shadow", 0), ("off", 0)])
def test_orientation_modes(spark, mode, side):
    from catalith.operators import scan

    hits = spark.createDataFrame([(1, 0, "a", 14), (1, 1, "b", 5), (2, 0, "a", 4), (2, 1, "a", 1), (3, 1, "a", 9), (4, 0, "a", 15), (5, 0, "a", 12), (5, 1, "a", 11)], "scan_id long, side int, id string, distance int")
    got = {r["scan_id"]: (r["would_flip"], r["side"]) for r in scan.orientation(spark.range(1, 7).withColumnRenamed("id", "scan_id"), hits, mode).collect()}
    assert got == {i: (i in (1, 3) and mode != "off", side if i in (1, 3) else 0) for i in range(1, 7)}
    with pytest.raises(ValueError, match="no orientation mode"):
        scan.orientation(hits, hits, "x")


def test_turned_crops_take_the_nearer_side(spark):
    from catalith.operators import scan

    hits = spark.createDataFrame([(1, 0, "a", 5), (1, 1, "b", 4), (2, 0, "a", 5), (2, 1, "b", 5), (3, 1, "b", 9), (4, 1, "b", 1)], "scan_id long, side int, id string, distance int")
    asked = spark.createDataFrame([(1, 0, True), (2, 0, True), (3, 0, True), (4, 0, False), (5, 0, True)], "scan_id long, side int, both boolean")
    assert sorted((r["scan_id"], r["id"]) for r in scan.better_side(hits, asked).collect()) == [(1, "b"), (2, "a"), (3, "b")]


def test_resolve_scans_resolves_every_part(spark, tmp_path):
    from tests.definitions import best_extent
    from catalith.plans.catalogue import resolve_scans

    names = ["small ring", "green bolt", "small bolt"]
    rows = [(i, names[i % 3], "Brand#1", "STANDARD", i % 7) for i in range(1, 121)]
    spark.createDataFrame(rows, "p_partkey int, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {r["scan_id"]: r["id"] for r in resolve_scans(spark, str(tmp_path)).collect()}
    assert got == {str(i): str(i) for i in range(1, 121)}
    scans = spark.createDataFrame([(str(r[0]), "</s>" + r[1].replace("l", "1")) for r in rows], "scan_id string, name string")
    cards = spark.createDataFrame([(str(r[0]), r[1]) for r in rows], "id string, name string")
    found = {(r["scan_id"], r["id"]) for r in resolve.name_candidates(scans, cards).collect()}
    best = lambda line: sorted((-s, str(r[0])) for r in rows if (s := best_extent(r[1], line)) > resolve.NAME_CUTOFF)[: resolve.NAME_TOP]
    assert found == {(str(r[0]), i) for r in rows for _, i in best("</s>" + r[1].replace("l", "1"))}


def test_blank_printed_texts_and_shared_face_images(spark, tmp_path):
    (tmp_path / "c.json").write_text(
        '{"id":"1","name":"A // B","set":"x","layout":"transform","lang":"DE","type_line":"Land","printed_type_line":" ","printed_text":"\\t","oracle_text":"o","card_faces":[{"name":"A","image_uris":{"normal":"n"}},{"image_uris":{"normal":"n","art_crop":""}},{}]}\n'
        '{"id":"2","name":"C","set":"x","lang":"EN","type_line":"Land","printed_type_line":"Country","printed_text":"p","oracle_text":"o","image_uris":{"normal":"n","art_crop":"a"},"card_faces":[{"name":"C"}]}\n'
        '{"id":"3","name":"D","set":"x","lang":" ","layout":"","type_line":"Land","printed_type_line":"Land 2"}\n'
    )
    raw = catalogue.read_cards(spark, str(tmp_path / "c.json"))
    p = {r["id"]: r for r in catalogue.printings_of(raw, F.lit("2026-01-01 00:00:00")).collect()}
    assert (p["1"]["type"], p["1"]["rules_text"], p["1"]["name"], p["1"]["lang"]) == ("Land", "o", "A // B", "DE")
    assert (p["2"]["type"], p["2"]["rules_text"], len(p["2"]["faces"])) == ("Land", "p", 1)
    assert (p["3"]["type"], p["3"]["lang"], p["3"]["layout"], p["3"]["faces"]) == ("Land", "en", "normal", None)
    none = {c: F.lit(None).cast("string") for c in ("image_object_key", "image_art_crop_key", "full_phash", "art_phash")}
    plan = {r["id"]: r for r in catalogue.image_plan(raw.withColumn("faces", catalogue.faces_of(F.col("card_faces"))).withColumns(none)).collect()}
    assert plan["1"]["uploads"] == ["printings/1/normal.jpg", "printings/1/face1/normal.jpg"] and plan["1"]["hashes"] == 1
    assert [f["image_object_key"] for f in plan["1"]["faces"]] == ["printings/1/normal.jpg", "printings/1/face1/normal.jpg", "printings/1/normal.jpg"]
    assert [f["name"] for f in plan["1"]["faces"]] == ["A", "", ""]
    assert plan["2"]["uploads"] == ["printings/2/normal.jpg", "printings/2/art_crop.jpg"] and plan["2"]["hashes"] == 2
    assert plan["3"]["uploads"] == [] and plan["3"]["hashes"] == 0 and plan["3"]["faces"] is None
