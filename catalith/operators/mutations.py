"""Changes of owner-scoped documents, many requests at once, each with an outcome: Ok, NotFound, Invalid or Conflict.

A batch names each document once (further requests for it go into the next batch). Every function gives a row for each
request: request_id, outcome, what it reports, and the document's new state where the outcome is Ok and something changed.
changed() puts these states into the table of documents. Requests meet documents, and ids meet printings, by equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.operators.documents import clashes, committed, moved, those, valid_name, with_default, without

OK, NOT_FOUND, INVALID, CONFLICT = "Ok", "NotFound", "Invalid", "Conflict"
#: Copies of one item and instances of one call at most; how long a selection lives.
MOST_COPIES, MOST_INSTANCES = 50, 500
SELECTION_TTL = "INTERVAL 7 DAYS"


def outcome(*cases: tuple[Column, str]) -> Column:
    """The outcome of the first case that holds, else Ok."""
    out = None
    for holds, name in cases:
        holds = F.coalesce(holds, F.lit(False))
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out.otherwise(OK)


def owned(docs: DataFrame, soft: bool = True) -> DataFrame:
    return docs.where(~F.col("is_removed")) if soft else docs


def with_document(requests: DataFrame, docs: DataFrame, key: str = "id", name: str = "doc", soft: bool = True) -> DataFrame:
    """requests with the document that `key` names, as a struct; null if there is none or it is another owner's."""
    found = owned(docs, soft).select(F.col("id").alias("__id"), F.col("owner_id").alias("__owner"), F.struct(*docs.columns).alias(name))
    return requests.join(found, (requests[key] == F.col("__id")) & (requests["owner_id"] == F.col("__owner")), "left").drop("__id", "__owner")


def create(requests: DataFrame, now: Column) -> DataFrame:
    """requests: request_id, owner_id, id, name. New documents without cards."""
    result = outcome((~F.coalesce(valid_name(F.col("name")), F.lit(False)), INVALID))
    return requests.select("request_id", result.alias("outcome"), "id", "owner_id", F.trim("name").alias("name"), F.lit(False).alias("is_removed"), now.alias("updated_at"))


def rename(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: request_id, owner_id, id, name."""
    rows = with_document(requests, docs)
    result = outcome((~F.coalesce(valid_name(F.col("name")), F.lit(False)), INVALID), (F.col("doc").isNull(), NOT_FOUND))
    return rows.select("request_id", "id", result.alias("outcome"), F.trim("name").alias("name"))


def soft_delete(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: request_id, owner_id, id. The document stays, but is not seen any more."""
    return with_document(requests, docs).select("request_id", "id", outcome((F.col("doc").isNull(), NOT_FOUND)).alias("outcome"), F.lit(True).alias("is_removed"))


def add_card(docs: DataFrame, requests: DataFrame, printings: DataFrame) -> DataFrame:
    """requests: request_id, owner_id, id and the card (instance_id, printing_id, is_foil, language, condition)."""
    known = printings.select(F.col("id").alias("printing_id"), F.lit(True).alias("__known")).distinct()
    rows = with_document(requests, docs).join(known, "printing_id", "left")
    card = F.struct("instance_id", "printing_id", "is_foil", with_default(F.col("language"), "en").alias("language"), with_default(F.col("condition"), "NM").alias("condition"))
    result = outcome((F.col("doc").isNull(), NOT_FOUND), (F.col("__known").isNull(), INVALID))
    return rows.select("request_id", "id", result.alias("outcome"), F.concat("doc.cards", F.array(card)).alias("cards"))


def remove_card(docs: DataFrame, requests: DataFrame, soft: bool = True) -> DataFrame:
    """requests: request_id, owner_id, id, instance_id. soft: whether docs can be removed (selections expire instead)."""
    rows = with_document(requests, docs, soft=soft)
    has = F.exists("doc.cards", lambda c: c["instance_id"] == F.col("instance_id"))
    return rows.select("request_id", "id", outcome((F.col("doc").isNull() | ~has, NOT_FOUND)).alias("outcome"), without(F.col("doc.cards"), F.array("instance_id")).alias("cards"))


def move_card(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: request_id, owner_id, id, to_id, instance_id."""
    rows = with_document(with_document(requests, docs), docs, "to_id", "target")
    has = F.exists("doc.cards", lambda c: c["instance_id"] == F.col("instance_id"))
    result = outcome((F.col("id") == F.col("to_id"), INVALID), (F.col("doc").isNull() | F.col("target").isNull() | ~has, NOT_FOUND))
    first = F.slice(those(F.col("doc.cards"), F.array("instance_id")), 1, 1)
    return rows.select("request_id", "id", "to_id", result.alias("outcome"), without(F.col("doc.cards"), F.array("instance_id")).alias("cards"), F.concat("target.cards", first).alias("to_cards"))


def bulk_add(docs: DataFrame, requests: DataFrame, printings: DataFrame) -> DataFrame:
    """requests: request_id, owner_id, id, items (printing_id, count, is_foil, language, condition). Also added and unknown.

    Instance ids are the request's id and a number. Unknown printings are found by an anti-join of the distinct ids."""
    wanted = requests.select("request_id", F.explode(F.array_distinct(F.transform("items", lambda i: i["printing_id"]))).alias("printing_id"))
    unknown = wanted.join(printings.select(F.col("id").alias("printing_id")).distinct(), "printing_id", "left_anti")
    unknown = unknown.groupBy("request_id").agg(F.sort_array(F.collect_list("printing_id")).alias("unknown"))
    rows = with_document(requests, docs).join(unknown, "request_id", "left")
    copies = lambda i: F.greatest(F.lit(1), F.least(F.lit(MOST_COPIES), F.coalesce(i["count"], F.lit(1))))
    total = F.aggregate("items", F.lit(0), lambda n, i: n + copies(i))
    nameless = F.exists("items", lambda i: F.coalesce(F.trim(i["printing_id"].cast("string")), F.lit("")) == "")
    result = outcome(
        (F.coalesce(F.size("items"), F.lit(0)) < 1, INVALID), (nameless, INVALID), (total > MOST_INSTANCES, INVALID), (F.col("doc").isNull(), NOT_FOUND), (F.size("unknown") > 0, INVALID)
    )
    flat = F.flatten(F.transform("items", lambda i: F.array_repeat(i, copies(i))))
    card = lambda i, n: F.struct(F.concat_ws("-", F.col("request_id").cast("string"), n.cast("string")).alias("instance_id"), i["printing_id"].alias("printing_id"), i["is_foil"].alias("is_foil"), with_default(i["language"], "en").alias("language"), with_default(i["condition"], "NM").alias("condition"))
    rows = rows.withColumn("outcome", result)
    fine = F.col("outcome") == OK
    created = F.when(fine, F.transform(flat, card))
    return rows.select("request_id", "id", "outcome", F.when(fine, total).otherwise(0).alias("added"), F.when(F.col("doc").isNotNull(), F.col("unknown")).alias("unknown"), F.concat("doc.cards", created).alias("cards"))


def bulk_remove(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: request_id, owner_id, id, instance_ids. Also removed and missing."""
    rows = with_document(requests, docs)
    rest, gone, missing = moved(F.col("doc.cards"), F.filter("doc.cards", lambda c: F.lit(False)), F.col("instance_ids"))
    rows = rows.withColumn("outcome", outcome((F.coalesce(F.size("instance_ids"), F.lit(0)) < 1, INVALID), (F.col("doc").isNull(), NOT_FOUND)))
    fine = F.col("outcome") == OK
    return rows.select("request_id", "id", "outcome", F.when(fine, F.size(gone)).alias("removed"), F.when(fine, missing).alias("missing"), F.when(fine, rest).alias("cards"))


def bulk_move(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: request_id, owner_id, id, to_id, instance_ids. Also moved and missing."""
    rows = with_document(with_document(requests, docs), docs, "to_id", "target")
    result = outcome((F.coalesce(F.size("instance_ids"), F.lit(0)) < 1, INVALID), (F.col("id") == F.col("to_id"), INVALID), (F.col("doc").isNull() | F.col("target").isNull(), NOT_FOUND))
    rest, into, _ = moved(F.col("doc.cards"), F.col("target.cards"), F.col("instance_ids"))
    rows = rows.withColumn("outcome", result)
    fine = F.col("outcome") == OK
    count = F.size(F.col("doc.cards")) - F.size(rest)
    missing = F.size(F.array_distinct("instance_ids")) - count
    return rows.select("request_id", "id", "to_id", "outcome", F.when(fine, count).alias("moved"), F.when(fine, missing).alias("missing"), F.when(fine, rest).alias("cards"), F.when(fine, into).alias("to_cards"))


def create_selection(requests: DataFrame, now: Column) -> DataFrame:
    """requests: request_id, owner_id, id. New selections without entries, which expire after SELECTION_TTL."""
    return requests.select("request_id", F.lit(OK).alias("outcome"), "id", "owner_id", now.alias("created_at"), (now + F.expr(SELECTION_TTL)).alias("expires_at"))


def get_selection(selections: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """requests: request_id, owner_id, id. The entries and the expiry; at the very moment of expiry a selection is still there."""
    rows = with_document(requests, selections.where(F.col("expires_at") >= now), soft=False)
    return rows.select("request_id", "id", outcome((F.col("doc").isNull(), NOT_FOUND)).alias("outcome"), "doc.cards", "doc.expires_at")


def unselect_card(selections: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """requests: request_id, owner_id, id, instance_id. Expired selections are not found."""
    return remove_card(selections.where(F.col("expires_at") >= now), requests, soft=False)


def select_card(selections: DataFrame, requests: DataFrame, printings: DataFrame, now: Column) -> DataFrame:
    """requests: request_id, owner_id, id, the entry (with confidence) and allow_duplicate. Expired selections are not found."""
    known = printings.select(F.col("id").alias("printing_id"), F.lit(True).alias("__known")).distinct()
    rows = with_document(requests, selections.where(F.col("expires_at") >= now), soft=False).join(known, "printing_id", "left")
    language = with_default(F.col("language"), "en")
    clash = ~F.col("allow_duplicate") & clashes(F.col("doc.cards"), F.col("printing_id"), F.col("is_foil"), language)
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    entry = F.struct("instance_id", "printing_id", "is_foil", language.alias("language"), with_default(F.col("condition"), "NM").alias("condition"), confidence.alias("confidence"))
    result = outcome((F.col("doc").isNull(), NOT_FOUND), (F.col("__known").isNull(), INVALID), (clash, CONFLICT))
    return rows.select("request_id", "id", result.alias("outcome"), F.concat("doc.cards", F.array(entry)).alias("cards"))


def commit_selection(selections: DataFrame, docs: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """requests: request_id, owner_id, id (selection), collection_id, instance_ids (null or empty: all). Also added and remaining."""
    rows = with_document(with_document(requests, selections.where(F.col("expires_at") >= now), soft=False), docs, "collection_id", "target")
    entries = F.col("doc.cards")
    some = F.coalesce(F.size("instance_ids"), F.lit(0)) > 0
    picked = F.when(some, those(entries, F.col("instance_ids"))).otherwise(entries)
    result = outcome((F.col("doc").isNull() | F.col("target").isNull(), NOT_FOUND), (F.size(picked) == 0, INVALID))
    rows = rows.withColumn("outcome", result).withColumn("picked", picked)
    fine = F.col("outcome") == OK
    rest = without(entries, F.transform("picked", lambda c: c["instance_id"]))
    return rows.select(
        "request_id", "id", "collection_id", "outcome", F.when(fine, F.size("picked")).alias("added"), F.when(fine, F.size(rest)).alias("remaining"),
        F.when(fine, rest).alias("cards"), F.when(fine, committed(F.col("picked"), None, now)).alias("new_cards"),
    )


def feedback(scans: DataFrame, requests: DataFrame, printings: DataFrame) -> DataFrame:
    """requests: request_id, owner_id, id (scan), printing_id. Also rank (1-based, null if no candidate) and candidates. Overwrites earlier feedback."""
    from catalith.operators.lookups import label_rank

    requests = requests.withColumn("printing_id", F.trim("printing_id"))
    known = printings.select(F.col("id").cast("string").alias("printing_id"), F.lit(True).alias("__known")).distinct()
    rows = with_document(requests, scans, soft=False).join(known, "printing_id", "left")
    result = outcome((F.col("doc").isNull(), "ScanNotFound"), (F.col("__known").isNull(), "UnknownPrinting"))
    rows = rows.withColumn("outcome", result)
    fine = F.col("outcome") == OK
    return rows.select("request_id", "id", "outcome", "printing_id", F.when(fine, label_rank(F.col("doc.candidates"), F.col("printing_id"))).alias("rank"), F.when(fine, F.size("doc.candidates")).alias("candidates"))


def changed(docs: DataFrame, answers: DataFrame, columns: list[str]) -> DataFrame:
    """docs with the new values of the named columns where the answer for a document is Ok."""
    new = answers.where(F.col("outcome") == OK).select("id", F.struct(*columns).alias("__new"))
    value = lambda c: F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c)
    return docs.join(new, "id", "left").select(*[value(c) if c in columns else F.col(c) for c in docs.columns])
