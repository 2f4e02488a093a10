"""Key and batch lookups, enrichment joins and paged browsing of reference data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def known(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is among ids."""
    return df.join(ids.select(key), key, "left_semi")


def unknown(ids: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Ids that df does not have."""
    return ids.join(df.select(key), key, "left_anti")


def hydrate(rows: DataFrame, printings: DataFrame, key: str, drop_missing: bool) -> DataFrame:
    """rows with their printing's columns; rows without one go or stay with nulls."""
    return rows.join(printings, key, "inner" if drop_missing else "left")


def hydrate_in_order(rows: DataFrame, printings: DataFrame, key: str, by: str, position: str = "position") -> DataFrame:
    """Nested candidates (array `by` of structs with `key`) with their printing, in their order; candidates without one go."""
    flat = rows.select(*[c for c in rows.columns if c != by], F.posexplode(by).alias(position, "__c")).select("*", "__c.*").drop("__c")
    return flat.withColumn(position, F.col(position) + 1).join(printings, key)


def printing_by_id(printings: DataFrame, group: Column, printing: Column) -> DataFrame:
    """The printing with this id if it belongs to the card (group is a condition on its columns), else nothing; no thumbnail key without an image."""
    return printings.where(group & (F.col("id") == printing)).withColumn("thumbnail_key", thumbnail(F.col("image_object_key"), F.col("id")))


def thumbnail(image: Column, printing: Column) -> Column:
    """The key of a printing's picture, null where it has none."""
    return F.when(image.isNotNull(), F.concat(F.lit("printings/"), printing.cast("string"), F.lit("/normal.jpg")))


def set_by_code(sets: DataFrame, code: str) -> DataFrame:
    return sets.where(F.col("code") == (code or "").strip().lower())


def with_latest_price(rows: DataFrame, latest: DataFrame, key: str = "id", values: tuple[str, ...] = ("eur", "eur_foil")) -> DataFrame:
    """rows with their latest prices, null where there is none."""
    return rows.join(latest.select(F.col("printing_id").alias(key), *values), key, "left")


def browse_weights(weights: DataFrame) -> DataFrame:
    return weights.orderBy(F.desc("weight"), "set_type")


def page_total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"))


def with_set_names(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """The set's name, or its code where the set is missing."""
    named = rows.join(sets.select(F.col("code").alias("set_code"), F.col("name").alias("__name")), "set_code", "left")
    return named.withColumn("set_name", F.coalesce("__name", "set_code")).drop("__name")


def printings_of(printings: DataFrame, sets: DataFrame, latest: DataFrame | None, group: Column) -> DataFrame:
    """All printings of one group: newest first (unknown last), then set, then collector number as text."""
    rows = with_set_names(printings.where(group), sets.select("code", "name", "released_at"))
    rows = rows.join(sets.select(F.col("code").alias("set_code"), "released_at"), "set_code", "left")
    if latest is not None:
        rows = with_latest_price(rows, latest)
    return rows.orderBy(F.col("released_at").desc_nulls_last(), "set_code", "collector_number", "id")


def browse_sets(sets: DataFrame, set_type: str | None = None, sort: str = "released_at", descending: bool = False, skip: int = 0, take: int = 50) -> DataFrame:
    """Sets by code, name or (released_at, code). By date, unknown dates come last ascending and first descending."""
    if set_type:
        sets = sets.where(F.col("set_type") == set_type.strip().lower())
    way = lambda c: F.col(c).desc_nulls_first() if descending else F.col(c).asc_nulls_last()
    order = {"code": ["code"], "name": ["name", "code"]}.get(sort, ["released_at", "code"])
    return sets.orderBy(*map(way, order)).offset(max(0, skip)).limit(min(200, max(1, take)))


def with_set_weights(printings: DataFrame, sets: DataFrame, weights: DataFrame, default: float = 0.5) -> DataFrame:
    """printing -> set -> set type -> weight; what is missing on the way gives the default."""
    rows = printings.join(sets.select(F.col("code").alias("set_code"), "set_type"), "set_code", "left")
    rows = rows.join(weights.select("set_type", "weight"), "set_type", "left")
    return rows.withColumn("weight", F.coalesce("weight", F.lit(default)))


def top_candidate(scans: DataFrame, printings: DataFrame) -> DataFrame:
    """Each scan with the printing of its first candidate, null without one."""
    first = F.get("candidates", F.lit(0))["printing_id"]
    return scans.withColumn("printing_id", first).join(printings, "printing_id", "left")


def label_rank(candidates: Column, label: Column) -> Column:
    """1-based position of the labelled printing among the candidates, null if absent."""
    return F.nullif(F.array_position(F.transform(candidates, lambda c: c["printing_id"]), label), F.lit(0))


def last_by(rows: DataFrame, keys: list[str], order: Column, values: list[str]) -> DataFrame:
    """The last row of each key; combined before the shuffle, unlike a window."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("__last")).select(*keys, "__last.*")


def first_by(rows: DataFrame, keys: list[str], order: list[Column], values: list[str], count: str | None = None) -> DataFrame:
    """The first row of each key in an ascending order, and how many rows the key has; combined before the shuffle, unlike a window."""
    ranked = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    aggs = [F.min_by(F.struct(*values), ranked).alias("__first")] + ([F.count(F.lit(1)).alias(count)] if count else [])
    return rows.groupBy(*keys).agg(*aggs).select(*keys, *([count] if count else []), "__first.*")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with their number in a total order. Sorted by range into tasks and numbered there; only the tasks' counts come together."""
    from catalith.session import written

    sorted_rows, _ = written(rows.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    counts = sorted_rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each task
    counts = counts.withColumn("__before", F.coalesce(before, F.lit(0))).select("__part", "__before")
    within = F.row_number().over(Window.partitionBy("__part").orderBy("__at"))
    return sorted_rows.withColumn("__in", within).join(F.broadcast(counts), "__part").withColumn(name, (F.col("__before") + F.col("__in")).cast("int")).drop("__part", "__at", "__in", "__before")


def weighted_lower_median(rows: DataFrame, keys: list[str], value: str, weight: str, order: str | None = None) -> DataFrame:
    """First value whose running weight reaches half of the total. Weights of equal values are summed first.

    With order, they are summed in the order of that column, so that rounding of doubles doesn't depend on how the rows come.
    The running weight and the total are summed in the order of the values."""
    if order is None:
        sums = rows.groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    else:
        same = Window.partitionBy(*keys, value).orderBy(order, weight)
        sums = rows.select(*keys, value, F.sum(weight).over(same.rowsBetween(Window.unboundedPreceding, 0)).alias("w"), F.lead(F.lit(True)).over(same).isNull().alias("__last"))
        sums = sums.where("__last").drop("__last")
    by = Window.partitionBy(*keys).orderBy(value)
    run = sums.withColumn("run", F.sum("w").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("half", F.sum("w").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) / 2)
    return run.where("run >= half").groupBy(*keys).agg(F.min(value).alias("median"))
