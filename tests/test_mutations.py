import datetime as dt

from pyspark.sql import functions as F

from catalith.operators import mutations, scanlog

CARD = "struct<instance_id:string,printing_id:string,is_foil:boolean,language:string,condition:string>"
DOCS = f"id int, owner_id string, name string, is_removed boolean, cards array<{CARD}>"


def docs(spark):
    card = lambda i, p="p": (i, p, False, "en", "NM")
    return spark.createDataFrame([(1, "a", "one", False, [card("x"), card("y"), card("y")]), (2, "a", "two", False, []), (3, "b", "three", False, [card("z")]), (4, "a", "gone", True, [card("w")])], DOCS)


def outcomes(df):
    return {r["request_id"]: r["outcome"] for r in df.collect()}


def test_names(spark):
    asked = spark.createDataFrame([(1, "a", 1, " new "), (2, "a", 3, "n"), (3, "a", 4, "n"), (4, "a", 2, "  "), (5, "a", 9, "x" * 65), (6, "b", 3, None)], "request_id int, owner_id string, id int, name string")
    done = mutations.rename(docs(spark), asked)
    assert outcomes(done) == {1: "Ok", 2: "NotFound", 3: "NotFound", 4: "Invalid", 5: "Invalid", 6: "Invalid"}
    assert {r["id"]: r["name"] for r in mutations.changed(docs(spark), done, ["name"]).collect()} == {1: "new", 2: "two", 3: "three", 4: "gone"}
    assert outcomes(mutations.create(asked, F.current_timestamp())) == {1: "Ok", 2: "Ok", 3: "Ok", 4: "Invalid", 5: "Invalid", 6: "Invalid"}
    gone = mutations.soft_delete(docs(spark), asked)
    assert outcomes(gone) == {1: "Ok", 2: "NotFound", 3: "NotFound", 4: "Ok", 5: "NotFound", 6: "Ok"}
    assert {r["id"] for r in mutations.changed(docs(spark), gone, ["is_removed"]).where("is_removed").collect()} == {1, 2, 3, 4}


def test_moves(spark):
    asked = spark.createDataFrame([(1, "a", 1, 2, "y"), (2, "a", 1, 1, "y"), (3, "a", 1, 3, "y"), (4, "a", 1, 2, "q"), (5, "b", 3, 9, "z")], "request_id int, owner_id string, id int, to_id int, instance_id string")
    done = {r["request_id"]: r for r in mutations.move_card(docs(spark), asked).collect()}
    assert {k: r["outcome"] for k, r in done.items()} == {1: "Ok", 2: "Invalid", 3: "NotFound", 4: "NotFound", 5: "NotFound"}
    assert [c["instance_id"] for c in done[1]["cards"]] == ["x"] and [c["instance_id"] for c in done[1]["to_cards"]] == ["y"]
    many = asked.withColumn("instance_ids", F.array("instance_id", F.lit("x"), F.lit("x")))
    done = {r["request_id"]: r for r in mutations.bulk_move(docs(spark), many).collect()}
    assert done[4]["moved"] == 1 and done[4]["missing"] == 1 and [c["instance_id"] for c in done[4]["to_cards"]] == ["x"]
    assert outcomes(mutations.bulk_remove(docs(spark), many.withColumn("instance_ids", F.slice("instance_ids", 1, 0)))) == {i: "Invalid" for i in range(1, 6)}


def test_history_page_and_detail(spark):
    day = lambda d: dt.datetime(2026, 1, d)
    scans = [(1, "a", day(1)), (2, "a", day(3)), (3, "b", day(2)), (4, None, day(4)), (5, "a", day(3))]
    columns = {"is_preprocessed": F.lit(True), "confidence": F.lit("Low"), **{z: F.lit(" x ") for z in scanlog.ZONES}}
    scans = spark.createDataFrame(scans, "scan_id int, owner_id string, scanned_at timestamp").withColumns(columns)
    rows = spark.createDataFrame([(2, 2, "q", 0.5, 0.1, None, None), (2, 1, "gone", 0.9, 0.2, 0.3, 4), (2, 3, "p", 0.1, 0.1, 0.0, 9)], "scan_id int, rank int, id string, combined double, ocr_score double, name_score double, distance int")
    logs = scanlog.scan_logs(scans, rows)
    cards = spark.createDataFrame([("p", "P"), ("q", "Q")], "id string, name string")
    page, total = scanlog.history(logs, F.lit("a"), cards, 0, 2)
    assert [(r["id"], r["printing_id"], r["name"]) for r in page.collect()] == [(2, "gone", None), (5, None, None)] and total.first()["total"] == 3
    assert [(r["position"], r["printing_id"], r["matched_by_hash"], r["matched_by_name"]) for r in scanlog.detail(logs, F.lit("a"), F.lit(2), cards).collect()] == [(2, "q", False, False), (3, "p", True, False)]
    assert scanlog.detail(logs, F.lit("b"), F.lit(2), cards).count() == 0 and logs.where("id = 4").count() == 0
    assert {r["ocr_name"] for r in logs.collect()} == {"x"}
