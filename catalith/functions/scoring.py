"""Scores of the entity resolution as column expressions. Thresholds and weights are fixed values, given as defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def distance_score(distance: Column, full: int = 2, zero: int = 12) -> Column:
    """1 up to `full` bits, 0 from `zero` on, linear between."""
    return F.when(distance <= full, 1.0).when(distance >= zero, 0.0).otherwise((F.lit(float(zero)) - distance) / float(zero - full))


def symbol_score(distance: Column) -> Column:
    return clamp(1 - distance / F.lit(64.0))


def should_flip(upright: Column, flipped: Column, least: int = 12, margin: int = 2) -> Column:
    """Null distances are 'no hit'."""
    bad = upright.isNull() | (upright >= least)
    return F.coalesce(bad & flipped.isNotNull() & (upright.isNull() | (upright - flipped >= margin)), F.lit(False))


def fuse(text: Column, hashed: Column) -> Column:
    """Probabilistic or of two scores, absent ones as 0."""
    a, b = (clamp(F.coalesce(x, F.lit(0.0))) for x in (text, hashed))
    return 1 - (1 - a) * (1 - b)


def with_prior(score: Column, weight: Column) -> Column:
    return clamp(score * F.coalesce(weight, F.lit(0.5)))


def smooth(confidence: Column, floor: float = 0.5) -> Column:
    return F.lit(floor) + F.lit(1 - floor) * confidence


#: Weights of the zones.
ZONE_WEIGHTS = {"name": 0.40, "type_line": 0.10, "rules_text": 0.20, "power_toughness": 0.10, "bottom": 0.20}


def zone_weight(zone: str, present: Column, confidence: Column) -> Column:
    return F.when(present, F.lit(ZONE_WEIGHTS[zone]) * smooth(clamp(confidence))).otherwise(0.0)


def aggregate_score(scores: dict[str, Column], weights: dict[str, Column]) -> Column:
    """Weighted mean over the zones that are present (weight above 0)."""
    top = sum((scores[z] * weights[z] for z in scores), F.lit(0.0))
    return clamp(F.coalesce(F.try_divide(top, sum(weights.values(), F.lit(0.0))), F.lit(0.0)))


def zones_at(scores: list[Column], threshold: float) -> Column:
    return sum(((s >= threshold).cast("int") for s in scores), F.lit(0))


def confidence_class(score: Column, zones: list[Column], confidences: list[Column], ocr: Column, least_read: float = 0.60) -> Column:
    """High: 0.85, two zones of 0.70 and one of them read with 0.60 (least_read; 0 or less asks for none). Medium: 0.60 and text aggregate 0.40. Else Low."""
    sure = sum((((z >= 0.70) & (c >= least_read)).cast("int") for z, c in zip(zones, confidences, strict=True)), F.lit(0))
    high = (score >= 0.85) & (zones_at(zones, 0.70) >= 2) & ((sure >= 1) if least_read > 0 else F.lit(True))
    medium = (score >= 0.60) & (ocr >= 0.40)
    return F.when(F.coalesce(high, F.lit(False)), "High").when(F.coalesce(medium, F.lit(False)), "Medium").otherwise("Low")


#: Score of the tier in which a collector line found a printing.
TIER_SCORES = {"symbol_and_text": 1.0, "symbol": 0.9, "set_text": 1.0, "number_and_rarity": 0.6, "number": 0.3}


def zero_below(score: Column, cutoff: float) -> Column:
    return F.when(score > cutoff, score).otherwise(0.0)


def box_centre(low: Column, high: Column) -> Column:
    return (low + high) / 2.0


def box_area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), y1 - y0)


#: Bands of a card's zones as (x low, x high, y low, y high) of a region's centre, in the order they are tried.
ZONE_BANDS = {
    "name": (0.05, 0.78, 0.04, 0.10),
    "type_line": (0.05, 0.78, 0.555, 0.605),
    "power_toughness": (0.78, 0.96, 0.885, 0.925),
    "bottom": (0.03, 0.40, 0.91, 0.97),
    "rules_text": (None, None, 0.62, 0.88),
}
#: Where the outermost regions of a well-cropped card lie, and the least span that is trusted.
CARD_X, CARD_Y, LEAST_SPAN = (0.05, 0.95), (0.07, 0.94), 0.20


def axis_rescale(value: Column, low: Column, high: Column, card: tuple[float, float]) -> Column:
    """The regions' extent [low, high] mapped to where a card's regions lie, if it spans LEAST_SPAN at least; else unchanged."""
    return F.when(high - low >= LEAST_SPAN, card[0] + (value - low) / (high - low) * (card[1] - card[0])).otherwise(value)


def zone_of(cx: Column, cy: Column) -> Column:
    """Zone of a region of a cropped card: the first band that holds its centre."""
    out = None
    for name, (x0, x1, y0, y1) in ZONE_BANDS.items():
        fits = cy.between(y0, y1) if x0 is None else cx.between(x0, x1) & cy.between(y0, y1)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise("unknown")


def zone_coverage(name: Column, type_line: Column, rules: Column, power: Column, bottom: Column) -> Column:
    """How many zones hold usable text, 0 to 5."""
    long = lambda c, n: F.coalesce(F.char_length(F.trim(c)) >= n, F.lit(False)).cast("int")
    return long(name, 3) + long(type_line, 1) + long(rules, 12) + long(power, 1) + long(bottom, 1)
