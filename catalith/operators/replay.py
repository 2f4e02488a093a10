"""Ordered folds: a batch of requests in their order, each outcome depending on those before, without a document's requests or
cards ever meeting in one task.

What a request finds splits in two. Whether its documents are there follows from when they were created and deleted: two
numbers a document, looked up by equi-joins. Whether a card is there follows from the requests that named that card: events
of a card are sorted and folded one after the other, so a batch is dealt by card, and a document or owner with many of the
requests is spread over its cards; cards that no request names are not folded. Counts and outcomes of a request are sums over its
cards."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from catalith.operators.documents import valid_name, with_default
from catalith.operators.mutations import INVALID, MOST_COPIES, MOST_INSTANCES, NOT_FOUND, OK, outcome
from catalith.session import drop_path, ship, written

CREATE, RENAME, DELETE, ADD, REMOVE, MOVE, BULK_ADD, BULK_REMOVE, BULK_MOVE = KINDS = ("create", "rename", "delete", "add", "remove", "move", "bulk_add", "bulk_remove", "bulk_move")
HAVE = "have"


def timelines(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """id, owner_id, name, is_removed, created (null: before the batch) and removed (null: not in it) of all documents, as order numbers."""
    made = requests.where((F.col("kind") == CREATE) & valid_name(F.col("name")))
    made = made.groupBy("id").agg(F.min_by(F.struct("owner_id", F.trim("name").alias("name"), F.col("seq").alias("created")), "seq").alias("d")).select("id", "d.*", F.lit(False).alias("is_removed"))
    old = docs.select("id", "owner_id", "name", F.lit(None).cast("long").alias("created"), "is_removed")
    every = old.unionByName(made.join(old.select("id"), "id", "left_anti").select(*old.columns))
    asked = requests.where(F.col("kind") == DELETE).select("id", "owner_id", "seq")
    gone = every.join(asked, ["id", "owner_id"]).where(~F.col("is_removed") & (F.col("created").isNull() | (F.col("created") < F.col("seq"))))
    return every.join(gone.groupBy("id").agg(F.min("seq").alias("removed")), "id", "left")


def _there(requests: DataFrame, lines: DataFrame, key: str, flag: str) -> DataFrame:
    """requests with whether the document that `key` names is the owner's and there at that moment."""
    seen = lines.where(~F.col("is_removed")).select(F.col("id").alias("__id"), F.col("owner_id").alias("__owner"), "created", "removed", F.lit(True).alias(flag))
    fits = (F.col("created").isNull() | (F.col("created") < F.col("seq"))) & (F.col("removed").isNull() | (F.col("removed") >= F.col("seq")))
    same = (F.col(key) == F.col("__id")) & (F.col("owner_id") == F.col("__owner"))
    return requests.join(seen, same & fits, "left").drop("__id", "__owner", "created", "removed").withColumn(flag, F.coalesce(flag, F.lit(False)))


def _copies(item: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(MOST_COPIES), F.coalesce(item["count"], F.lit(1))))


def judged(requests: DataFrame, lines: DataFrame, printings: DataFrame) -> DataFrame:
    """requests with `early`: the outcome as far as documents, names and printings decide it, and `unknown` printings; written.

    Requests are wide, so each goes only to the lookups that its kind needs: all to their document, moves to their target, additions
    to the printings that are unknown, which are told from the distinct ones. One after the other, so that their shuffles don't add up."""
    kind, items = F.col("kind"), F.col("items")
    adds, moves = kind.isin(ADD, BULK_ADD), kind.isin(MOVE, BULK_MOVE)
    wanted = requests.where(adds).select("request_id", F.explode(F.array_distinct(F.transform("items", lambda i: i["printing_id"]))).alias("printing_id"))
    strange, _ = written(wanted.select("printing_id").distinct().join(printings.select(F.col("id").alias("printing_id")), "printing_id", "left_anti"))
    missing = wanted.join(strange.withColumnRenamed("printing_id", "__strange"), F.col("printing_id").eqNullSafe(F.col("__strange")))
    missing, _ = written(missing.groupBy("request_id").agg(F.sort_array(F.collect_list("printing_id")).alias("unknown")))
    none, no = F.lit(None).cast(missing.schema["unknown"].dataType), F.lit(False)
    added = _there(requests.where(adds), lines, "id", "found").withColumn("target", no).join(missing, "request_id", "left")
    moved = _there(_there(requests.where(moves), lines, "id", "found"), lines, "to_id", "target").withColumn("unknown", none)
    rest = _there(requests.where(~F.coalesce(adds | moves, no)), lines, "id", "found").withColumn("target", no).withColumn("unknown", none)
    nameless = F.exists(items, lambda i: F.coalesce(F.trim(i["printing_id"].cast("string")), F.lit("")) == "")
    many = F.aggregate(items, F.lit(0), lambda n, i: n + _copies(i)) > MOST_INSTANCES
    early = outcome(
        (kind.isin(CREATE, RENAME) & ~F.coalesce(valid_name(F.col("name")), F.lit(False)), INVALID),
        (kind.isin(BULK_REMOVE, BULK_MOVE) & (F.coalesce(F.size("instance_ids"), F.lit(0)) < 1), INVALID),
        ((kind == BULK_ADD) & ((F.coalesce(F.size(items), F.lit(0)) < 1) | nameless | many), INVALID),
        (moves & (F.col("id") == F.col("to_id")), INVALID),
        ((kind != CREATE) & ~F.col("found"), NOT_FOUND),
        (moves & ~F.col("target"), NOT_FOUND),
        (adds & (F.size("unknown") > 0), INVALID),
    )
    done = [written(part.withColumn("early", early).withColumn("unknown", F.when(F.col("found"), F.col("unknown"))))[0] for part in (added, moved, rest)]
    return done[0].unionByName(done[1]).unionByName(done[2])


def new_cards(rows: DataFrame) -> DataFrame:
    """request_id, seq, id, ord and card of each card that requests to add make: ids are given for a single one, else made of the request's."""
    flat = F.flatten(F.transform("items", lambda i: F.array_repeat(i, F.when(F.col("kind") == ADD, 1).otherwise(_copies(i)))))
    exploded = rows.where(F.col("kind").isin(ADD, BULK_ADD)).select("request_id", "seq", "kind", "id", "instance_ids", F.posexplode(flat).alias("ord", "i"))
    given = F.when(F.col("kind") == ADD, F.get("instance_ids", F.lit(0))).otherwise(F.concat_ws("-", F.col("request_id").cast("string"), F.col("ord").cast("string")))
    card = F.struct(
        given.alias("instance_id"), F.col("i.printing_id").alias("printing_id"), F.col("i.is_foil").alias("is_foil"), with_default(F.col("i.language"), "en").alias("language"), with_default(F.col("i.condition"), "NM").alias("condition")
    )
    return exploded.select("request_id", "seq", "id", "ord", card.alias("card"))


def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Events (instance, seq, ord, kind, from, to, request) sorted by instance, seq and ord; one card's state is held at a time.

    Yields (request, copies hit, None...) for each request that finds the card, and in the end each copy: its document, its key (the order
    in the document: when it came, and how it lay where it came from) and where it was made (request or document, and number)."""

    def copies(held: list) -> Iterator[tuple]:
        for doc, key, request, origin, n in held:
            yield None, None, doc, key, request, origin, n

    last, held = None, []
    for instance, seq, n, kind, source, target, request in rows:
        if instance != last:
            yield from copies(held)
            last, held = instance, []
        if kind == HAVE:
            held.append((target, [seq, n], None, target, n))
        elif kind in (ADD, BULK_ADD):
            held.append((target, [seq, n], request, None, n))
        else:
            mine = sorted((h for h in held if h[0] == source), key=lambda h: h[1])
            if not mine:
                continue
            yield request, len(mine), None, None, None, None, None
            held = [h for h in held if h[0] != source]
            if kind in (MOVE, BULK_MOVE):
                # cards moved together keep their order by their former keys; one that is moved alone needs none
                held += [(target, [seq] if kind == MOVE else [seq, *h[1]], *h[2:]) for h in (mine[:1] if kind == MOVE else mine)]
    yield from copies(held)


def _folded(events: DataFrame, request: T.DataType, document: T.DataType) -> DataFrame:
    ship(events.sparkSession)
    names = ["request_id", "hit", "doc", "key", "origin_request", "origin_doc", "origin_ord"]
    kinds = [request, T.IntegerType(), document, T.ArrayType(T.LongType()), request, document, T.IntegerType()]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        from catalith.operators.replay import fold

        arrow = [to_arrow_type(t) for t in kinds]
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[tuple] = []
        table = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow, strict=True)], names=names)
        for row in fold(rows):
            out.append(row)
            if len(out) == 10_000:
                yield table()
                out.clear()
        if out:
            yield table()

    dealt = events.repartition("instance_id").sortWithinPartitions("instance_id", "seq", "ord")
    return dealt.select("instance_id", "seq", "ord", "kind", "source", "target", "request_id").mapInArrow(run, schema)


def replay(docs: DataFrame, requests: DataFrame, printings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, documents) after all requests in the order of seq; the same as one after the other.

    docs: id, owner_id, name, is_removed, cards (instance_id, printing_id, is_foil, language, condition), updated_at.
    requests: request_id, seq (distinct), at, owner_id, kind (one of KINDS), id, and as the kind needs them to_id, name, instance_ids (one for
    add, remove and move), items (printing_id, count, is_foil, language, condition; one for add). printings: id.
    answers: request_id, seq, kind, outcome, done (cards added, removed or moved), missing, unknown (printings).

    A card's events of one batch are held one at a time; a document's cards are one row, as everywhere. Documents that no
    request names keep their row untouched. Cards moved together keep the order they had."""
    spark = docs.sparkSession
    # read again by each lookup; what a kind doesn't use stays out of their shuffles
    uses = {"items": (ADD, BULK_ADD), "to_id": (MOVE, BULK_MOVE), "name": (CREATE, RENAME)}
    requests, asked_at = written(requests.withColumns({c: F.when(F.col("kind").isin(*kinds), F.col(c)) for c, kinds in uses.items()}))
    lines, _ = written(timelines(docs, requests))
    rows = judged(requests, lines, printings)
    drop_path(spark, asked_at)
    kind = F.col("kind")
    leaves = kind.isin(REMOVE, BULK_REMOVE, MOVE, BULK_MOVE)
    fine = rows.where(F.col("early") == OK)
    added = new_cards(fine)
    none = F.lit(None)
    out = fine.where(leaves)
    leaving = out.select(F.explode(F.array_distinct("instance_ids")).alias("instance_id"), "seq", F.lit(0).alias("ord"), "kind", F.col("id").alias("source"), F.col("to_id").alias("target"), "request_id")
    coming = added.select(F.col("card.instance_id").alias("instance_id"), "seq", "ord", F.lit(ADD).alias("kind"), none.cast(docs.schema["id"].dataType).alias("source"), F.col("id").alias("target"), "request_id")
    out = out.where(F.size("instance_ids") > 0)
    gets = fine.where(kind.isin(ADD, BULK_ADD) & (F.size("items") > 0))
    touched = out.select("id").unionByName(out.select(F.col("to_id").alias("id"))).unionByName(gets.select("id")).where("id is not null").distinct()
    old = docs.join(touched, "id", "left_semi").select("id", F.posexplode("cards").alias("ord", "card"))
    held, _ = written(old.select(F.col("card.instance_id").alias("instance_id"), "ord", "id"))  # so that the documents' shuffle goes before the events'
    first = held.select("instance_id", F.lit(-1).cast("long").alias("seq"), "ord", F.lit(HAVE).alias("kind"), none.cast(docs.schema["id"].dataType).alias("source"), F.col("id").alias("target"), none.cast(requests.schema["request_id"].dataType).alias("request_id"))
    events = first.unionByName(coming)
    # told where a card's events meet to be folded, so they are shuffled once
    named = F.max(leaves).over(Window.partitionBy("instance_id"))
    asked = events.unionByName(leaving).withColumn("named", named).where("named").drop("named")
    folded, _ = written(_folded(asked, requests.schema["request_id"].dataType, docs.schema["id"].dataType))
    # cards that no request names stay where they came to be; only the documents need them
    same = F.col("instance_id").eqNullSafe(F.col("named"))
    still = events.join(leaving.select(F.col("instance_id").alias("named")).distinct(), same, "left_anti").select(
        F.lit(None).cast(folded.schema["request_id"].dataType).alias("request_id"), F.lit(None).cast("int").alias("hit"), F.col("target").alias("doc"), F.array(F.col("seq").cast("long"), F.col("ord").cast("long")).alias("key"),
        F.when(F.col("kind") == ADD, F.col("request_id")).alias("origin_request"), F.when(F.col("kind") == HAVE, F.col("target")).alias("origin_doc"), F.col("ord").cast("int").alias("origin_ord"),
    )
    hits = folded.where("hit is not null").groupBy("request_id").agg(F.sum("hit").cast("int").alias("copies"), F.count(F.lit(1)).cast("int").alias("ids"))
    ok = F.col("outcome") == OK
    made = F.nullif(F.aggregate("items", F.lit(0), lambda n, i: n + F.when(kind == ADD, 1).otherwise(_copies(i))), F.lit(0))
    kept = rows.select("request_id", "seq", "at", "kind", "id", "to_id", "name", "early", "unknown", F.when(kind.isin(ADD, BULK_ADD), made).alias("made"), F.size(F.array_distinct("instance_ids")).alias("wanted"))
    hit = F.coalesce((F.col("early") == OK) & leaves, F.lit(False))
    nothing = {c: F.lit(None).cast("int") for c in ("copies", "ids")}
    answers = kept.where(hit).join(hits, "request_id", "left").unionByName(kept.where(~hit).withColumns(nothing))
    lost = kind.isin(REMOVE, MOVE) & F.col("copies").isNull()
    answers = answers.withColumn("outcome", F.when((F.col("early") == OK) & lost, NOT_FOUND).otherwise(F.col("early")))
    done = F.when(kind.isin(ADD, BULK_ADD), F.col("made")).when(kind == MOVE, 1).when(kind.isin(REMOVE, BULK_REMOVE, BULK_MOVE), F.coalesce("copies", F.lit(0)))
    missing = F.when(kind.isin(BULK_REMOVE, BULK_MOVE), F.col("wanted") - F.coalesce(F.when(kind == BULK_REMOVE, F.col("ids")).otherwise(F.col("copies")), F.lit(0)))
    answers = answers.withColumn("done", F.when(ok, done)).withColumn("missing", F.when(ok, missing))
    answers, _ = written(answers.select("request_id", "seq", "at", "kind", "id", "to_id", "name", "outcome", "done", "missing", "unknown"))
    return answers.select("request_id", "seq", "kind", "outcome", "done", "missing", "unknown"), _documents(docs, lines, answers, folded.unionByName(still), old, added, touched)


def _documents(docs: DataFrame, lines: DataFrame, answers: DataFrame, folded: DataFrame, old: DataFrame, added: DataFrame, touched: DataFrame) -> DataFrame:
    """The documents after the batch: cards of those that requests touched are put together anew."""
    placed = folded.where("doc is not null")
    kept = placed.where("origin_request is null").join(old.select(F.col("id").alias("origin_doc"), F.col("ord").alias("origin_ord"), "card"), ["origin_doc", "origin_ord"]).select("doc", "key", "card")
    made = placed.where("origin_request is not null").join(added.select(F.col("request_id").alias("origin_request"), F.col("ord").alias("origin_ord"), "card"), ["origin_request", "origin_ord"]).select("doc", "key", "card")
    fields = docs.schema["cards"].dataType.elementType.names
    same = made.select("doc", "key", F.struct(*[F.col(f"card.{c}").alias(c) for c in fields]).alias("card"))
    cards = kept.unionByName(same).groupBy(F.col("doc").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("key", "card"))), lambda x: x["card"]).alias("new_cards"))
    good = answers.where(F.col("outcome") == OK)
    changes = good.where(F.coalesce(F.col("done"), F.lit(1)) > 0)
    at = changes.select("id", "at").unionByName(changes.where(F.col("kind").isin(MOVE, BULK_MOVE)).select(F.col("to_id").alias("id"), "at")).groupBy("id").agg(F.max("at").alias("new_at"))
    names = good.where(F.col("kind") == RENAME).groupBy("id").agg(F.max_by(F.trim("name"), "seq").alias("new_name"))
    empty = F.array().cast(docs.schema["cards"].dataType)
    rows = lines.join(docs.select("id", "cards", "updated_at"), "id", "left").join(cards, "id", "left").join(touched.withColumn("touched", F.lit(True)), "id", "left").join(names, "id", "left").join(at, "id", "left")
    return rows.select(
        "id", "owner_id", F.coalesce("new_name", "name").alias("name"), (F.col("is_removed") | F.col("removed").isNotNull()).alias("is_removed"),
        F.when(F.col("touched"), F.coalesce("new_cards", empty)).otherwise(F.coalesce("cards", empty)).alias("cards"), F.coalesce("new_at", "updated_at").alias("updated_at"),
    )
