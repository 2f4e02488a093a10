"""Scan logs: what a resolved scan leaves behind, its history, and counts over outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalith.functions.parsing import blank_to_null, parse_type_line, split_power_toughness

ZONES = ["name", "type_line", "rules_text", "power_toughness", "bottom"]


def matched_by(row: Column, distance: str = "distance", name: str = "name_score") -> tuple[Column, Column]:
    """(by hash, by name): whether a candidate has a hash hit, and whether its name scored."""
    return row[distance].isNotNull(), F.coalesce(row[name], F.lit(0.0)) > 0


def ocr_size(width: Column, height: Column, local_width: Column, local_height: Column) -> Column:
    """struct(width, height): the sizes OCR reports where both are positive, else the local ones."""
    told = F.coalesce((width > 0) & (height > 0), F.lit(False))
    return F.struct(F.when(told, width).otherwise(local_width).alias("width"), F.when(told, height).otherwise(local_height).alias("height"))


def scan_logs(scans: DataFrame, rows: DataFrame) -> DataFrame:
    """A log row for each scan that has an owner and a preprocessed image, candidates nested in the order of their rank.

    scans: scan_id, owner_id, scanned_at, is_preprocessed, confidence and the zones' texts. rows: scan_id, rank, id, combined,
    ocr_score, name_score, distance."""
    each = F.struct("rank", F.col("id").alias("printing_id"), "combined", "ocr_score", "name_score", "distance")
    nested = rows.groupBy("scan_id").agg(F.array_sort(F.collect_list(each)).alias("c"))

    def candidate(c: Column) -> Column:
        by_hash, by_name = matched_by(c)
        zero = lambda x: F.coalesce(c[x], F.lit(0.0)).alias(x)
        return F.struct(c["printing_id"].alias("printing_id"), c["combined"].alias("combined"), zero("ocr_score"), zero("name_score"), c["distance"].alias("distance"), by_hash.alias("matched_by_hash"), by_name.alias("matched_by_name"))

    logged = scans.where((F.coalesce(F.length("owner_id"), F.lit(0)) > 0) & F.coalesce("is_preprocessed", F.lit(False)))
    logged = logged.withColumns({z: blank_to_null(F.col(z)) for z in ZONES}).withColumn("parsed", parse_type_line(F.col("type_line"))).withColumn("size", split_power_toughness(F.col("power_toughness")))
    out = logged.join(nested, "scan_id", "left")
    shown = F.coalesce("c", F.array().cast(nested.schema["c"].dataType))
    return out.select(
        F.col("scan_id").alias("id"), "owner_id", "scanned_at", "confidence", *[F.col(z).alias(f"ocr_{z}") for z in ZONES],
        F.col("parsed.supertype").alias("supertype"), blank_to_null(F.col("parsed.type")).alias("type"), F.col("parsed.subtype").alias("subtype"), F.col("size.power").alias("power"), F.col("size.toughness").alias("toughness"),
        F.transform(shown, candidate).alias("candidates"),
    )


def history(logs: DataFrame, owner: Column, printings: DataFrame, skip: int = 0, take: int = 25, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """(page, total) of an owner's scans, newest first, ties by id; each with its first candidate's printing, null if that is gone.

    The page is cut before printings are joined."""
    mine = logs.where(F.col("owner_id") == owner)
    page = mine.orderBy(F.desc("scanned_at"), "id").offset(max(0, skip)).limit(min(most, max(1, take)))
    page = page.withColumn("printing_id", F.get("candidates", F.lit(0))["printing_id"])
    page = page.join(printings.withColumnRenamed("id", "printing_id"), "printing_id", "left").orderBy(F.desc("scanned_at"), "id")
    return page, mine.agg(F.count(F.lit(1)).alias("total"))


def detail(logs: DataFrame, owner: Column, scan_id: Column, printings: DataFrame) -> DataFrame:
    """The candidates of an owner's scan that still have a printing, in their order (position from 1)."""
    one = logs.where((F.col("id") == scan_id) & (F.col("owner_id") == owner))
    rows = one.select(F.col("id").alias("scan_id"), F.posexplode("candidates").alias("position", "c")).select("scan_id", (F.col("position") + 1).alias("position"), "c.*")
    return rows.join(printings.withColumnRenamed("id", "printing_id"), "printing_id").orderBy("position")


def outcomes(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """scans, mean, low and high of a value by tags, combined before the shuffle."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("scans"), F.round(F.avg(value), 6).alias("mean_value"), F.min(value).alias("low"), F.max(value).alias("high"))


def pool_summary(scans: DataFrame, rows: DataFrame, score: str = "ocr_score") -> DataFrame:
    """best (0 without rows) and scored (rows above 0) of each scan's scored pool."""
    each = rows.groupBy("scan_id").agg(F.max(score).alias("best"), F.count_if(F.col(score) > 0).alias("scored"))
    return scans.select("scan_id").join(each, "scan_id", "left").select("scan_id", F.coalesce("best", F.lit(0.0)).alias("best"), F.coalesce("scored", F.lit(0)).alias("scored"))


#: Upper bounds of a histogram's buckets where none are given.
BOUNDS = (0.0, 5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 250.0, 500.0, 750.0, 1000.0, 2500.0, 5000.0, 7500.0, 10000.0)


def bucket_of(value: Column, bounds: tuple[float, ...] = BOUNDS) -> Column:
    """The upper bound (inclusive) of a value's bucket; infinity above all bounds. Null for null and NaN."""
    out = F.when(value.isNull() | F.isnan(value), F.lit(None).cast("double"))
    for b in sorted(bounds):
        out = out.when(value <= b, F.lit(float(b)))
    return out.otherwise(F.lit(float("inf")))


def histogram(rows: DataFrame, by: list, value: str, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """records, total, low, high of a value by tags and bucket, combined before the shuffle. On a stream, `by` may hold a window
    of an event time with a watermark."""
    number = F.col(value).cast("double")
    kept = rows.withColumn("bucket", bucket_of(number, bounds)).where(F.col("bucket").isNotNull())
    return kept.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("records"), F.sum(number).alias("total"), F.min(number).alias("low"), F.max(number).alias("high"))


def merged_histograms(rows: DataFrame, by: list[str]) -> DataFrame:
    """Histograms of several runs or micro-batches with the same bounds as one."""
    return rows.groupBy(*by, "bucket").agg(F.sum("records").alias("records"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))


def histogram_quantiles(rows: DataFrame, by: list[str], share: float, name: str = "quantile") -> DataFrame:
    """The quantile by tags, linear within the bucket that holds it, whose ends are drawn in to the values seen there."""
    order = Window.partitionBy(*by).orderBy("bucket")
    run = rows.withColumn("upto", F.sum("records").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("records").over(Window.partitionBy(*by)))
    wanted = F.lit(share) * F.col("all")
    hit = run.where((F.col("upto") >= wanted) & (F.col("upto") - F.col("records") < wanted) | ((F.col("upto") == F.col("records")) & (wanted <= 0)))
    part = (wanted - (F.col("upto") - F.col("records"))) / F.col("records")
    return hit.select(*by, (F.col("low") + part * (F.col("high") - F.col("low"))).alias(name))


def quantile_sketches(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """A mergeable quantile sketch by tags, of bounded size; see sketch_quantiles() and merged_sketches()."""
    return rows.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double")).alias("sketch"), F.count(value).alias("records"))


def merged_sketches(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of several runs or micro-batches by tags as one each."""
    return rows.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("records").alias("records"))


def sketch_quantiles(rows: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """One column a share, named p50 for 0.5; within about 1.5 % of the rank."""
    return rows.select(*by, "records", *[F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(f"p{round(100 * p)}") for p in shares])
