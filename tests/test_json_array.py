"""The splittable array reader against json, on files cut at every offset."""

import json
import random

import pytest

from catalith.sources import catalogue, json_array

TRICKY = [
    {"id": "1", "name": 'a "quoted" } name', "card_faces": [{"name": "x{[", "oracle_text": "\\"}, {"name": "\\\\\""}]},
    None, 7, "text } \" {",
    {"id": "2", "name": "é日本😀}", "prices": {"eur": "1.5"}},
    {}, [{"id": "inner"}], {"id": "3", "name": "\n\t\\u007d }}}"},
    {"id": "4", "name": "plain"},
]


def cut(data: bytes, every: int) -> list[tuple[int, list[str]]]:
    """Splits with their records, as a reader of records that end with a brace deals them: a record belongs to the split it begins in."""
    found, at = {}, 0
    while at < len(data):
        end = data.find(b"}", at)
        end = len(data) if end < 0 else end
        # the first record of a later split is left to the one before it
        split = 0 if at == 0 else (at - 1) // every * every
        found.setdefault(split, []).append(data[at:end].decode())
        at = end + 1
    return sorted(found.items())


def read(splits, batch=3):
    chunks = lambda records: (("}".join(records[i : i + batch]) + "}").encode() for i in range(0, len(records), batch))
    effects = []
    for split, records in splits:
        out, quoted = (False, 0, 0), (True, 0, 0)
        for c in chunks(records):
            out, quoted = json_array.effect(c, out), json_array.effect(c, quoted)
        effects.append(("f", split, *out, *quoted))
    known, whole, parts = json_array.states(effects), [], {}
    for split, records in splits:
        inside, depth, owner = known["f", split]
        for text, begins, ends in json_array.elements(chunks(records), inside, depth):
            if begins and ends:
                whole.append(text)
            else:
                parts.setdefault(split if begins else owner, []).append(text)
    return sorted(json.dumps(json.loads(t)) for t in [*whole, *(b"".join(p) for p in parts.values())] if t.startswith(b"{"))


@pytest.mark.parametrize("indent", [None, 1])
def test_equal_to_json_wherever_it_is_cut(indent):
    data = json.dumps(TRICKY, indent=indent, ensure_ascii=False).encode() + b"\n"
    want = sorted(json.dumps(x) for x in TRICKY if isinstance(x, dict))
    for every in range(1, len(data) + 2):
        for batch in (1, 3):
            assert read(cut(data, every), batch) == want, every


def test_random_arrays():
    rng = random.Random(4)
    value = lambda d: rng.choice([1, None, '"', "\\", "}{", "a\\\"}"]) if d == 0 or rng.random() < 0.4 else [value(d - 1) for _ in range(rng.randint(0, 3))] if rng.random() < 0.4 else {rng.choice('ab"}'): value(d - 1) for _ in range(rng.randint(0, 3))}
    for _ in range(60):
        rows = [value(4) for _ in range(rng.randint(0, 12))]
        data = json.dumps(rows).encode()
        assert read(cut(data, rng.randint(1, 40))) == sorted(json.dumps(x) for x in rows if isinstance(x, dict))


@pytest.mark.parametrize("size", ["17b", "400b", "1m"])
def test_spark_reads_the_same_in_splits_of_any_size(spark, tmp_path, size):
    rows = [{"id": str(i), "name": f'n "{i}" }}{{' + "x" * (i % 90), "card_faces": [{"name": "}"}] * (i % 3)} for i in range(60)] + TRICKY
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.json").write_text(json.dumps(rows, ensure_ascii=False))
    (tmp_path / "a/two.json").write_text(json.dumps([{"id": "last", "name": None}], indent=2))
    (tmp_path / "a/none.json").write_text("[]")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        if size == "17b":
            (tmp_path / "a/one.json").write_text(json.dumps(rows[-12:], ensure_ascii=False))
        got = catalogue.read_cards(spark, str(tmp_path / "a"), lines=False)
        names = sorted((r["id"], str(r["name"]), len(r["card_faces"] or [])) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    kept = rows[-12:] if size == "17b" else rows
    assert names == sorted((x["id"], str(x.get("name")), len(x.get("card_faces") or [])) for x in [*kept, {"id": "last"}] if isinstance(x, dict) and "id" in x)
