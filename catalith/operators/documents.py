"""Owner-scoped nested documents: visibility, flattening, pages, and bulk changes on the arrays inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The groups of administrators.
ADMIN_GROUPS = ("mtg-admins", "platform-admins")


def visible(collections: DataFrame, owner: str) -> DataFrame:
    return collections.where((F.col("owner_id") == owner) & ~F.col("is_removed"))


def alive(selections: DataFrame, now: Column) -> DataFrame:
    """Expired documents are not seen; at the very moment of expiry they still are."""
    return selections.where(F.col("expires_at") >= now)


def by_id(documents: DataFrame, owner: str, key: Column) -> DataFrame:
    """The owner's document with this id, if it is there and not removed."""
    return visible(documents, owner).where(F.col("id") == key)


def overview(collections: DataFrame, owner: str) -> DataFrame:
    return visible(collections, owner).select("id", "name", F.size("cards").alias("card_count")).orderBy("name", "id")


def flattened(collections: DataFrame, owner: str) -> DataFrame:
    """A row for each card with the document it is in."""
    mine = visible(collections, owner)
    return mine.select(F.col("id").alias("collection_id"), F.col("name").alias("collection_name"), F.explode("cards").alias("card")).select("collection_id", "collection_name", "card.*")


def card_page(rows: DataFrame, printings: DataFrame, skip: int, take: int, most: int = 200) -> DataFrame:
    """A page of flattened rows by name without regard to case; sorted and cut before wide columns are joined, rows whose printing is gone then drop out."""
    names = printings.select(F.col("id").alias("printing_id"), F.col("name").alias("__name"))
    keyed = rows.join(names, "printing_id", "left").withColumn("__sort", F.upper(F.coalesce("__name", F.lit("")))).drop("__name")
    page = keyed.orderBy("__sort", "instance_id").offset(max(0, skip)).limit(min(most, max(1, take)))
    return page.join(printings.withColumnRenamed("id", "printing_id"), "printing_id").orderBy("__sort", "instance_id").drop("__sort")


def card_total(rows: DataFrame) -> DataFrame:
    """All rows of a page's list, before hydrating drops any."""
    return rows.agg(F.count(F.lit(1)).alias("total"))


def valid_name(name: Column) -> Column:
    return F.char_length(F.trim(name)).between(1, 64)


def without(cards: Column, ids: Column) -> Column:
    return F.filter(cards, lambda c: ~F.array_contains(ids, c["instance_id"]))


def those(cards: Column, ids: Column) -> Column:
    return F.filter(cards, lambda c: F.array_contains(ids, c["instance_id"]))


def moved(source: Column, target: Column, ids: Column) -> tuple[Column, Column, Column]:
    """(source, target, number of ids that were missing) after moving cards; all instances are kept, none twice."""
    wanted = F.array_distinct(ids)
    have = F.array_intersect(wanted, F.transform(source, lambda c: c["instance_id"]))
    return without(source, wanted), F.concat(target, those(source, wanted)), F.size(wanted) - F.size(have)


def repeated(items: DataFrame, copies: Column, most: int = 50) -> DataFrame:
    """Each row `copies` times (1 to most), numbered from 1."""
    n = F.greatest(F.lit(1), F.least(F.lit(most), copies.cast("int")))
    return items.withColumn("copy", F.explode(F.sequence(F.lit(1), n)))


def clashes(cards: Column, printing: Column, foil: Column, language: Column) -> Column:
    """Whether a card of the same printing, finish and language (without regard to case) is there; the condition does not matter."""
    return F.exists(cards, lambda c: (c["printing_id"] == printing) & (c["is_foil"] == foil) & (F.upper(c["language"]) == F.upper(language)))


def with_default(value: Column, default: str) -> Column:
    """The value, or the default for a null or empty one; blanks are a value."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def committed(entries: Column, ids: Column | None, now: Column) -> Column:
    """Selection entries (all, or those listed) as cards of a collection: ids stay, the confidence goes."""
    chosen = entries if ids is None else those(entries, ids)
    card = lambda c: F.struct(*[c[x].alias(x) for x in ("instance_id", "printing_id", "is_foil", "language", "condition")], now.alias("acquired_at"))
    return F.transform(chosen, card)


def feedback_changed_top(feedback: Column, candidates: Column) -> Column:
    """Feedback given, and not the first candidate's printing."""
    top = F.get(candidates, F.lit(0))["printing_id"]
    return F.coalesce(F.nullif(feedback, F.lit("")).isNotNull(), F.lit(False)) & ~feedback.eqNullSafe(top)


def is_admin(groups: Column, admins: tuple[str, ...] = ADMIN_GROUPS) -> Column:
    """Whether any of the groups is an administrators' group."""
    return F.arrays_overlap(groups, F.array(*map(F.lit, admins)))
