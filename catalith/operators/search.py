"""Faceted fuzzy search: optional predicates, one representative row and a count for each group, allow-listed sorts, pages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions.parsing import RARITY_RANK, lookup
from catalith.functions.trigram import similarity_to
from catalith.operators.lookups import first_by


@dataclass(frozen=True)
class SearchRequest:
    """What is None is not asked for. Blank strings are None; case is made as the columns have it by canonical()."""

    q: str | None = None
    type_line: str | None = None
    set_code: str | None = None
    rarity: str | None = None
    color: str | None = None
    colors: Sequence[str] = field(default_factory=tuple)
    cmc: float | None = None
    cmc_min: float | None = None
    cmc_max: float | None = None
    power: str | None = None
    toughness: str | None = None
    sort: str | None = None
    descending: bool | None = None
    skip: int = 0
    take: int = 25

    def canonical(self, most: int = 100) -> SearchRequest:
        clean = lambda x: (x or "").strip() or None
        down = lambda x: (clean(x) or "").lower() or None
        colors = self.colors.replace(",", " ").split() if isinstance(self.colors, str) else self.colors
        sort = self.sort if self.sort in SORTS else ("relevance" if clean(self.q) else "name")
        if sort == "relevance" and not clean(self.q):
            sort = "name"
        falling = True if sort == "relevance" else self.descending if self.descending is not None else sort == "released_at"
        return SearchRequest(
            clean(self.q), clean(self.type_line), down(self.set_code), down(self.rarity), (clean(self.color) or "").upper() or None,
            tuple(dict.fromkeys(c.strip().upper() for c in colors if c.strip())), self.cmc, self.cmc_min, self.cmc_max,
            clean(self.power), clean(self.toughness), sort, falling, max(0, self.skip), min(most, max(1, self.take)),
        )


SORTS = ("relevance", "name", "cmc", "released_at", "rarity")


def predicates(r: SearchRequest, threshold: float = 0.2) -> list[Column]:
    """Only the conditions that are set, so that plain ones reach the scan; trigram scores are compared as 32-bit values."""
    out = []
    for value, name in ((r.set_code, "set_code"), (r.rarity, "rarity"), (r.power, "power"), (r.toughness, "toughness")):
        if value is not None:
            out.append(F.col(name) == value)
    for value, op in ((r.cmc, "__eq__"), (r.cmc_min, "__ge__"), (r.cmc_max, "__le__")):
        if value is not None:
            out.append(getattr(F.col("cmc"), op)(F.lit(value).cast("float")))
    if r.color:
        out.append(F.array_contains("color_identity", r.color))
    out += [F.array_contains("color_identity", c) for c in r.colors]
    if r.q:
        out.append(similarity_to(F.col("name"), r.q).cast("double") > threshold)
    if r.type_line:
        out.append(similarity_to(F.col("type_line_full"), r.type_line).cast("double") > threshold)
    return out


def filtered(printings: DataFrame, r: SearchRequest) -> DataFrame:
    for p in predicates(r):
        printings = printings.where(p)
    return printings


def representatives(printings: DataFrame, sets: DataFrame, group: str = "oracle_id") -> DataFrame:
    """One row a group with its printing_count: English first, then with image, newest, not foil, smallest id.

    sets is the small dimension; Catalyst broadcasts it where it is small. Count and best row are combined before the one
    shuffle, so a group of any size is no single task."""
    joined = printings.join(sets.select(F.col("code").alias("set_code"), "released_at"), "set_code", "left")
    age = F.coalesce(-F.unix_date("released_at"), F.lit(2**31 - 1))  # newest first, unknown last
    order = [F.coalesce(F.col("lang") != "en", F.lit(True)), F.col("image_object_key").isNull(), age, F.col("is_foil"), F.col("id")]
    return first_by(joined, [group], order, [c for c in joined.columns if c != group], "printing_count")


def sort_order(r: SearchRequest, group: str = "oracle_id") -> list[Column]:
    way = lambda c: c.desc_nulls_last() if r.descending else c.asc_nulls_last()
    first = {
        "relevance": [similarity_to(F.col("name"), r.q or "").desc()],
        "cmc": [way(F.col("cmc"))],
        "released_at": [way(F.col("released_at"))],
        "rarity": [way(F.coalesce(lookup(F.col("rarity"), RARITY_RANK), F.lit(6)))],
        "name": [way(F.col("name"))],
    }[r.sort]
    return [*first, F.col("name").asc(), F.col(group).asc()]


def search(printings: DataFrame, sets: DataFrame, request: SearchRequest, group: str = "oracle_id") -> DataFrame:
    """A page of representatives. Filters come before the choice of representatives, so both it and the count follow them."""
    r = request.canonical()
    return representatives(filtered(printings, r), sets, group).orderBy(*sort_order(r, group)).offset(r.skip).limit(r.take)


def search_total(printings: DataFrame, request: SearchRequest, group: str = "oracle_id") -> DataFrame:
    return filtered(printings, request.canonical()).agg(F.count_distinct(group).alias("total"))
