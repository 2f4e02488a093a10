"""A batch of requests at once against the same requests one after the other."""

import datetime as dt
import random
import time

import pytest

from catalith.operators import replay

CARD = "struct<instance_id:string,printing_id:string,is_foil:boolean,language:string,condition:string>"
DOCS = f"id int, owner_id string, name string, is_removed boolean, cards array<{CARD}>, updated_at timestamp"
REQUESTS = "request_id int, seq long, at timestamp, owner_id string, kind string, id int, to_id int, name string, instance_ids array<string>, items array<struct<printing_id:string,count:int,is_foil:boolean,language:string,condition:string>>"
START = dt.datetime(2026, 1, 1)


def moment(n):
    return START + dt.timedelta(minutes=n)


def one_by_one(docs, requests, known):
    """docs: {id: [owner, name, removed, cards, at]}; requests in order."""
    docs = {i: [*d[:3], list(d[3]), d[4]] for i, d in docs.items()}
    answers = {}
    for request, _, at, owner, kind, key, to, name, ids, items in requests:
        mine = lambda k: docs[k] if k in docs and docs[k][0] == owner and not docs[k][2] else None  # noqa: E731, B023
        doc, target = mine(key), mine(to)
        copies = [max(1, min(50, i[1] or 1)) for i in items or []]
        unknown = sorted({i[0] for i in items or [] if i[0] not in known}) or None
        result, done, missing = "Ok", None, None
        if kind in ("create", "rename") and not 1 <= len((name or "").strip(" ")) <= 64:
            result = "Invalid"
        elif kind in ("bulk_remove", "bulk_move") and not ids or kind == "bulk_add" and (not items or sum(copies) > 500 or any(not (i[0] or "").strip() for i in items)) or kind in ("move", "bulk_move") and key == to:
            result = "Invalid"
        elif kind != "create" and doc is None or kind in ("move", "bulk_move") and target is None:
            result = "NotFound"
        elif kind in ("add", "bulk_add") and unknown:
            result = "Invalid"
        elif kind == "create":
            docs[key] = [owner, name.strip(" "), False, [], at]
        elif kind == "rename":
            doc[1], doc[4] = name.strip(" "), at
        elif kind == "delete":
            doc[2], doc[4] = True, at
        elif kind in ("add", "bulk_add"):
            flat = items[:1] if kind == "add" else [i for i, n in zip(items, copies) for _ in range(n)]
            new = [(ids[0] if kind == "add" else f"{request}-{n}", i[0], i[2], i[3] or "en", i[4] or "NM") for n, i in enumerate(flat)]
            doc[3] += new
            doc[4], done = at, len(new)
        else:
            picked = [c for c in doc[3] if c[0] in ids]
            if not picked and kind in ("remove", "move"):
                result = "NotFound"
            else:
                doc[3] = [c for c in doc[3] if c[0] not in ids]
                into = picked[:1] if kind == "move" else picked if kind == "bulk_move" else []
                done = 1 if kind == "move" else len(picked)
                if kind.startswith("bulk"):
                    missing = len(set(ids)) - (len({c[0] for c in picked}) if kind == "bulk_remove" else len(picked))
                if into:
                    target[3] += into
                    target[4] = at
                if picked:
                    doc[4] = at
        answers[request] = (result, done, missing, unknown if doc else None)
    return answers, docs


def compare(spark, docs, requests, known, parts=3):
    frame = spark.createDataFrame([(i, d[0], d[1], d[2], d[3], d[4]) for i, d in docs.items()], DOCS)
    shuffled = random.Random(0).sample(requests, len(requests))
    asked = spark.createDataFrame(shuffled, REQUESTS).repartition(parts)
    answers, after = replay.replay(frame, asked, spark.createDataFrame([(k,) for k in known], "id string"))
    want, state = one_by_one(docs, requests, known)
    assert {r["request_id"]: (r["outcome"], r["done"], r["missing"], r["unknown"]) for r in answers.collect()} == want
    got = {r["id"]: [r["owner_id"], r["name"], r["is_removed"], [tuple(c) for c in r["cards"]], r["updated_at"]] for r in after.collect()}
    assert got == state
    return want


def test_add_remove_and_move_on_one_document_in_one_batch(spark):
    item = [("p", None, False, " ", "")]
    docs = {1: ["a", "one", False, [("x", "p", True, "de", "LP")], START], 2: ["a", "two", False, [], START]}
    requests = [
        (1, 10, moment(1), "a", "add", 1, None, None, ["n"], item),
        (2, 20, moment(2), "a", "move", 1, 2, None, ["n"], None),
        (3, 30, moment(3), "a", "remove", 1, None, None, ["n"], None),  # it has gone
        (4, 40, moment(4), "a", "bulk_move", 2, 1, None, ["n", "x", "x"], None),  # x never was in 2
        (5, 50, moment(5), "a", "remove", 1, None, None, ["x"], None),
        (6, 60, moment(6), "a", "delete", 1, None, None, None, None),
        (7, 70, moment(7), "a", "remove", 1, None, None, ["n"], None),  # the document has gone
        (8, 80, moment(8), "a", "delete", 1, None, None, None, None),
    ]
    want = compare(spark, docs, requests, ["p"])
    assert [want[i][0] for i in range(1, 9)] == ["Ok", "Ok", "NotFound", "Ok", "Ok", "Ok", "NotFound", "NotFound"] and want[4][1:3] == (1, 1)


@pytest.mark.parametrize("seed", range(3))
def test_random_batches(spark, seed):
    rng = random.Random(seed)
    docs = {i: [rng.choice("ab"), f"d{i}", rng.random() < 0.1, [(f"c{i}-{n}", "p", False, "en", "NM") for n in range(rng.randint(0, 6))], START] for i in range(6)}
    docs[0][3] += [("twice", "p", True, "en", "NM"), ("twice", "q", True, "fr", "NM")]
    ids = [c[0] for d in docs.values() for c in d[3]]
    requests = []
    for n in range(220):
        kind = rng.choice(replay.KINDS[1:]) if rng.random() < 0.95 else "create"
        if kind == "delete" and rng.random() < 0.8:
            kind = "bulk_move"
        key = 100 + n if kind == "create" else rng.choice([*range(7), *(r[5] for r in requests if r[4] == "create")])
        items = [(rng.choice(["p", "q", "p", "no", " "] if rng.random() < 0.2 else ["p", "q"]), rng.choice([None, 1, 3, -2, 99]), rng.random() < 0.5, rng.choice([None, "", " ", "de"]), rng.choice([None, "LP"])) for _ in range(rng.randint(0, 3))]
        picked = [rng.choice(ids) for _ in range(rng.randint(0, 4))]
        if kind == "add":
            items, picked = [("p", 7, False, None, "")], [f"new{n}"]
        elif kind in ("remove", "move"):
            picked = [rng.choice(ids)]
        if kind in ("add", "bulk_add"):
            ids += [f"new{n}"] if kind == "add" else [f"{n}-0", f"{n}-1"]
        requests.append((n, 1000 + 3 * n, moment(n), rng.choice("ab") if rng.random() < 0.3 else (docs.get(key) or ["a"])[0], kind, key, rng.choice(range(7)) if "move" in kind else None, rng.choice(["x", " y ", "", "z" * 65]) if kind in ("create", "rename") else None, picked, items if "add" in kind else None))
    want = compare(spark, docs, requests, ["p", "q"])
    assert {w[0] for w in want.values()} == {"Ok", "NotFound", "Invalid"}


def test_no_requests_and_no_documents(spark):
    docs = {1: ["a", "one", False, [("x", "p", True, "de", "LP")], START]}
    compare(spark, docs, [], ["p"])
    compare(spark, {}, [(1, 1, START, "a", "remove", 1, None, None, ["x"], None)], ["p"])


def test_one_card_with_many_events_is_folded_in_one_pass():
    events = [("x", -1, 0, "have", None, 1, None)] + [("x", n, 0, "move", 1 + n % 2, 2 - n % 2, n) for n in range(200_000)]
    rows = list(replay.fold(iter(events)))
    assert len(rows) == 200_001 and rows[-1] == (None, None, 1, [199_999], None, 1, 0)


def test_only_named_cards_are_folded(spark, monkeypatch):
    docs = {1: ["a", "one", False, [(f"c{n}", "p", True, "de", "LP") for n in range(5)], START]}
    requests = [(1, 10, moment(1), "a", "add", 1, None, None, ["n"], [("p", None, False, "de", "LP")]), (2, 20, moment(2), "a", "remove", 1, None, None, ["c3"], None)]
    seen, folded = [], replay._folded
    monkeypatch.setattr(replay, "_folded", lambda events, *kinds: seen.append(sorted(r["instance_id"] for r in events.collect())) or folded(events, *kinds))
    compare(spark, docs, requests, ["p"])
    assert seen == [["c3", "c3"]]


def test_requests_are_made_once_and_shuffles_leave_no_files(spark):
    from pyspark.sql import functions as F

    docs = {i: ["a", f"d{i}", False, [(f"c{i}-{n}", "p", False, "en", "NM") for n in range(3)], START] for i in range(50)}
    requests = [(n, n, moment(n), "a", ("move", "bulk_remove", "add", "delete")[n % 4], n % 50, (n + 1) % 50, None, [f"c{n % 50}-{n % 3}"], [("p", None, False, "de", "LP")]) for n in range(400)]
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(kind):
        made.add(1)
        return kind

    frame = spark.createDataFrame([(i, d[0], d[1], d[2], d[3], d[4]) for i, d in docs.items()], DOCS)
    asked = spark.createDataFrame(requests, REQUESTS).repartition(3).withColumn("kind", counted("kind"))
    before = shuffle_files(spark)
    answers, after = replay.replay(frame, asked, spark.createDataFrame([("p",)], "id string"))
    assert made.value == len(requests)  # not again for each lookup
    until = time.time() + 10
    while shuffle_files(spark) - before and time.time() < until:  # they go soon after each step
        time.sleep(0.2)
    assert shuffle_files(spark) <= before
    want, _ = one_by_one(docs, requests, ["p"])
    assert {r["request_id"]: r["outcome"] for r in answers.collect()} == {k: w[0] for k, w in want.items()} and after.count() == 50


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}
