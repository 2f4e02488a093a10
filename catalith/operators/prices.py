"""Store-on-change price series: latest value of each key, and a point only where the value changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalith.operators.lookups import last_by

VALUES = ["eur", "eur_foil"]


def last_wins(batch: DataFrame, key: str = "printing_id", seq: str = "seq", values: list[str] | None = None) -> DataFrame:
    return last_by(batch, [key], F.col(seq), values or VALUES)


def changed(values: list[str], old: str) -> Column:
    """Whether any value differs, nulls being equal."""
    out = F.lit(False)
    for v in values:
        out = out | ~F.col(v).eqNullSafe(F.col(f"{old}_{v}"))
    return out


def points_of(observations: DataFrame, key: str, day: str, seq: str, values: list[str]) -> DataFrame:
    """All points of a whole history at once: the last row of each key and day, kept where it differs from the day before.

    A leading run without any value has no point."""
    daily = last_by(observations, [key, day], F.col(seq), values)
    order = Window.partitionBy(key).orderBy(day)
    had = F.lit(False)
    for v in values:
        had = had | F.col(v).isNotNull()
    seen = F.coalesce(F.max(had.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) == 1
    daily = daily.withColumn("__seen", seen).where("__seen")
    for v in values:
        daily = daily.withColumn(f"__old_{v}", F.lag(v).over(order))
    first = F.row_number().over(order) == 1
    return daily.withColumn("__first", first).where(F.col("__first") | changed(values, "__old")).select(key, day, *values)


def ingest_batch(batch: DataFrame, latest: DataFrame, points: DataFrame, observed_on: Column, source: Column, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(latest, points, written) after a batch of observations of one day; written are the points it added or overwrote.

    Compared with the latest value; equal values add no point; a change overwrites the day's point. Keys with no value yet
    and none now are left out. Replaying a batch changes nothing. Values are held to two decimals before the comparison."""
    rows = last_wins(batch.select("seq", "printing_id", *[F.col(v).cast("decimal(12,2)").alias(v) for v in VALUES]))
    old = latest.select("printing_id", *[F.col(v).alias(f"old_{v}") for v in VALUES], F.lit(True).alias("has"))
    rows = rows.join(old, "printing_id", "left").where(F.col("has") | F.col("eur").isNotNull() | F.col("eur_foil").isNotNull())
    moved = rows.where(F.col("has").isNull() | changed(VALUES, "old"))
    written = moved.select("printing_id", observed_on.cast("date").alias("observed_on"), *VALUES, source.cast("string").alias("source"))
    new_latest = latest.join(rows.select("printing_id"), "printing_id", "left_anti").unionByName(rows.select("printing_id", *VALUES, now.cast("timestamp").alias("updated_at")))
    new_points = points.join(written.select("printing_id", "observed_on"), ["printing_id", "observed_on"], "left_anti").unionByName(written)
    return new_latest, new_points, written


def ingest_days(batch: DataFrame, latest: DataFrame, source: Column) -> tuple[DataFrame, DataFrame]:
    """(latest rows of the batch's keys, points to write) for observations (seq, printing_id, observed_on, values) of several days.

    As ingest_batch() day by day, but at once: each day's last row is compared with the day before it in the batch, the first
    with the latest value. updated_at is the last day."""
    typed = batch.select("seq", "printing_id", "observed_on", *[F.col(v).cast("decimal(12,2)").alias(v) for v in VALUES])
    daily = last_by(typed, ["printing_id", "observed_on"], F.col("seq"), VALUES)
    old = latest.select("printing_id", *[F.col(v).alias(f"was_{v}") for v in VALUES], F.lit(True).alias("has"))
    rows = daily.join(old, "printing_id", "left")
    order = Window.partitionBy("printing_id").orderBy("observed_on")
    priced = F.lit(False)
    for v in VALUES:
        priced = priced | F.col(v).isNotNull()
    known = F.max((F.coalesce("has", F.lit(False)) | priced).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1
    rows = rows.withColumn("known", known).where("known")
    first = F.row_number().over(order) == 1
    rows = rows.withColumns({f"old_{v}": F.when(first, F.col(f"was_{v}")).otherwise(F.lag(v).over(order)) for v in VALUES} | {"new": first & F.col("has").isNull()})
    points = rows.where(F.col("new") | changed(VALUES, "old")).select("printing_id", "observed_on", *VALUES, source.cast("string").alias("source"))
    last = last_by(rows, ["printing_id"], F.col("observed_on"), [*VALUES, "observed_on"])
    return last.select("printing_id", *VALUES, F.col("observed_on").cast("timestamp").alias("updated_at")), points


def history(points: DataFrame, today: Column, retention_days: int = 365, start: Column | None = None, end: Column | None = None, day: str = "observed_on") -> DataFrame:
    """Points from the later of start and today - retention, up to end, oldest first."""
    floor = F.date_sub(today, retention_days)
    points = points.where(F.col(day) >= (F.greatest(start, floor) if start is not None else floor))
    if end is not None:
        points = points.where(F.col(day) <= end)
    return points.orderBy(day, *[c for c in ("printing_id",) if c in points.columns])
