"""Selections as a stream: requests up to the moment of expiry, timers behind the watermark."""

import datetime as dt
from types import SimpleNamespace

from pyspark.sql import functions as F

from catalith.streaming import selections

START = dt.datetime(2026, 1, 1)
LAST = START + dt.timedelta(days=7)
FIELDS = [c.split()[0] for c in selections.REQUESTS.split(", ")]


def request(n, at, kind, key="s", owner="a", card=None, printing="p", foil=False, language=None, again=False, known=True):
    return (n, at, owner, kind, key, card, printing, foil, language, None, 1.5, again, known)


def run(spark, tmp_path, batches):
    """Answers, one micro-batch a file, and all that timers gave."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, selections.REQUESTS).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / f"stage{i}"))
    landing = tmp_path / "in"
    landing.mkdir()
    import os
    import time

    for i in range(len(batches)):
        (file,) = (tmp_path / f"stage{i}").glob("part*.parquet")
        file.rename(landing / f"{i}.parquet")
        moment = time.time() - 1000 + i
        os.utime(landing / f"{i}.parquet", (moment, moment))
    stream = spark.readStream.schema(selections.REQUESTS).option("maxFilesPerTrigger", 1).parquet(str(landing))
    out = selections.selection_stream(stream, "1 minute")
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(selections.ANSWERS).parquet(str(tmp_path / "out")).collect()


def test_expiry_at_the_exact_moment(spark, tmp_path):
    micro = dt.timedelta(microseconds=1)
    batches = [
        [request(1, START, "create"), request(2, START + micro, "add", card="x"), request(3, START + 2 * micro, "add", card="y"), request(4, START, "create", key="t")],
        [request(5, LAST, "get"), request(6, LAST + micro, "get"), request(7, LAST, "remove", card="x"), request(8, LAST + micro, "create", key="other")],
        [request(9, LAST + dt.timedelta(hours=2), "create", key="last")],
        [request(10, LAST + dt.timedelta(hours=3), "get", key="s"), request(11, LAST + dt.timedelta(hours=3), "get", key="last", owner="b")],
    ]
    rows = run(spark, tmp_path, batches)
    got = {r["request_id"]: (r["outcome"], r["cards"]) for r in rows if r["request_id"]}
    # 3 is the same card again; 5 and 7 come at the moment of expiry, 6 and 8 a microsecond later
    assert got == {1: ("Ok", 0), 2: ("Ok", 1), 3: ("Conflict", None), 4: ("Ok", 0), 5: ("Ok", 1), 7: ("Ok", 0), 6: ("NotFound", None), 8: ("Ok", 0), 9: ("Ok", 0), 10: ("NotFound", None), 11: ("NotFound", None)}
    expired = sorted((r["id"], r["at"], r["cards"]) for r in rows if r["kind"] == "expired")
    assert expired == [("s", LAST, 0), ("t", LAST, 0)]


def test_requests_of_one_selection_in_their_order():
    row = lambda *a, **k: SimpleNamespace(**dict(zip(FIELDS, request(*a, **k))))
    asked = [
        row(1, START, "add"), row(2, START, "create"), row(3, START, "create"), row(4, START, "add", card="x", language="DE", known=False), row(5, START, "add", card="x", language="DE"),
        row(6, START, "add", card="y", language="de"), row(7, START, "add", card="y", language="de", again=True), row(8, START, "add", card="z", foil=True), row(9, START, "get", owner="b"),
        row(10, START, "remove", card="q"), row(11, START, "remove", card="x"), row(12, LAST, "get"), row(13, LAST + dt.timedelta(seconds=1), "create", owner="b"), row(14, LAST + dt.timedelta(seconds=2), "get", owner="b"),
    ]
    state, answers = selections.answered(None, asked)
    want = ["NotFound", "Ok", "Conflict", "Invalid", "Ok", "Conflict", "Ok", "Ok", "NotFound", "NotFound", "Ok", "Ok", "Ok", "Ok"]
    assert [a[3] for a in answers] == want and [a[4] for a in answers if a[4] is not None] == [0, 1, 2, 3, 2, 2, 0, 0]
    assert state[0] == "b" and state[2] == []


def test_selections_in_batches(spark):
    from catalith.operators import mutations

    card = "struct<instance_id:string,printing_id:string,is_foil:boolean,language:string,condition:string,confidence:double>"
    kept = spark.createDataFrame([(1, "a", [("x", "p", False, "en", "NM", 1.0)], START), (2, "a", [("y", "p", False, "en", "NM", 1.0)], START - dt.timedelta(microseconds=1))], f"id int, owner_id string, cards array<{card}>, expires_at timestamp")
    asked = spark.createDataFrame([(1, "a", 1, "x"), (2, "a", 2, "y"), (3, "b", 1, "x"), (4, "a", 1, "y")], "request_id int, owner_id string, id int, instance_id string")
    now = F.lit(START)
    assert {r["request_id"]: r["outcome"] for r in mutations.get_selection(kept, asked, now).collect()} == {1: "Ok", 2: "NotFound", 3: "NotFound", 4: "Ok"}
    assert {r["request_id"]: r["outcome"] for r in mutations.unselect_card(kept, asked, now).collect()} == {1: "Ok", 2: "NotFound", 3: "NotFound", 4: "NotFound"}
    made = mutations.create_selection(asked, now).first()
    assert made["expires_at"] - made["created_at"] == dt.timedelta(days=7) and made["outcome"] == "Ok"
