"""Parsers of catalogue strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"
#: Known supertypes, peeled from the left of a type line.
SUPERTYPES = ["Basic", "Legendary", "Snow", "World", "Ongoing", "Token", "Tribal", "Host", "Elite"]
#: Printed rarity letters.
RARITY_LETTERS = {"C": "common", "U": "uncommon", "R": "rare", "M": "mythic", "S": "special", "L": "common"}
#: Printed language codes.
PRINTED_LANGUAGES = {
    "EN": "en",
    "ES": "es",
    "SP": "es",
    "FR": "fr",
    "DE": "de",
    "IT": "it",
    "PT": "pt",
    "JP": "ja",
    "JA": "ja",
    "KO": "ko",
    "RU": "ru",
    "CS": "zhs",
    "CT": "zht",
    "PH": "ph",
}
#: Rank of a rarity in sorts; others come last.
RARITY_RANK = {"common": 1, "uncommon": 2, "rare": 3, "mythic": 4, "special": 5}


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def lookup(key: Column, values: dict) -> Column:
    """The dictionary's value, null if absent."""
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def full_type_line(supertype: Column, kind: Column, subtype: Column) -> Column:
    """'[Super ]Type[ - Sub]' with a long dash, trimmed, null if empty."""
    text = F.concat(F.coalesce(F.concat(supertype, F.lit(" ")), F.lit("")), F.coalesce(kind, F.lit("")), F.coalesce(F.concat(F.lit(f" {DASH} "), subtype), F.lit("")))
    return F.nullif(F.trim(text), F.lit(""))


def display_type_line(supertype: Column, kind: Column, subtype: Column) -> Column:
    """As full_type_line, but blank parts are left out and the result is never null."""
    front = F.concat_ws(" ", blank_to_null(supertype), blank_to_null(kind))
    return F.concat_ws(f" {DASH} ", F.nullif(front, F.lit("")), blank_to_null(subtype))


def parse_type_line(line: Column) -> Column:
    """struct(supertype, type, subtype): split at the first long dash, else at ' - '; known supertypes go from the left."""
    at = F.when(F.instr(line, DASH) > 0, F.instr(line, DASH)).when(F.instr(line, " - ") > 0, F.instr(line, " - ") + 1).otherwise(F.lit(0))
    front = F.trim(F.when(at > 0, F.substr(line, F.lit(1), at - 1)).otherwise(line))
    sub = F.when(at > 0, blank_to_null(F.substr(line, at + 1)))
    known = rf"(?i)^((?:(?:{'|'.join(SUPERTYPES)})(?:\s+|$))*)"
    upper = F.regexp_extract(front, known, 1)
    return F.when(
        line.isNotNull(),
        F.struct(
            F.nullif(F.regexp_replace(F.trim(upper), r"\s+", " "), F.lit("")).alias("supertype"),
            F.trim(F.substr(front, F.char_length(upper) + 1)).alias("type"),
            sub.alias("subtype"),
        ),
    )


#: Patterns of a collector line ('n/total [R]', 'R nnn') and of its set and language.
_LEGACY = r"(?i)(\d{1,4})\s*/\s*\d{1,4}\s*([CURMS])?"
_MODERN = r"\b([CURMSL])\s*(\d{3,4})\b"
_PLACE = r"\b([A-Z][A-Z0-9]{2,4})\s*[•·.\-‐‒*,]?\s*(EN|ES|SP|FR|DE|IT|PT|JP|JA|KO|RU|CS|CT|PH)\b"


def parse_collector_line(text: Column) -> Column:
    """struct(number, rarity, set_code, lang), null if no number is found: 'n/total [R]' first, else 'R nnn'."""
    legacy, modern = text.rlike(_LEGACY), text.rlike(_MODERN)
    number = F.when(legacy, F.regexp_extract(text, _LEGACY, 1)).when(modern, F.regexp_extract(text, _MODERN, 2))
    letter = F.upper(F.when(legacy, F.regexp_extract(text, _LEGACY, 2)).when(modern, F.regexp_extract(text, _MODERN, 1)))
    bare = F.regexp_replace(number, "^0+", "")
    short = F.when(bare != "", bare).otherwise(number)
    placed = text.rlike(_PLACE)
    return F.when(
        number.isNotNull(),
        F.struct(
            short.alias("number"),
            lookup(letter, RARITY_LETTERS).cast("string").alias("rarity"),
            F.when(placed, F.lower(F.regexp_extract(text, _PLACE, 1))).alias("set_code"),
            F.when(placed, lookup(F.regexp_extract(text, _PLACE, 2), PRINTED_LANGUAGES).cast("string")).alias("lang"),
        ),
    )


#: Fixed value: a power / toughness pair anywhere in a text.
POWER_TOUGHNESS = r"(\*|\d+(?:\+\*)?)\s*[/⁄]\s*(\*|\d+(?:\+\*)?)"


def power_toughness_score(text: Column, power: Column, toughness: Column) -> Column:
    """1.0 if both parts of the text agree, 0.5 if one does, else 0.0."""
    same = lambda i, x: F.coalesce(F.lower(F.regexp_extract(text, POWER_TOUGHNESS, i)) == F.lower(x), F.lit(False)).cast("int")
    hits = same(1, power) + same(2, toughness)
    return F.when(F.coalesce(text.rlike(POWER_TOUGHNESS), F.lit(False)), hits / F.lit(2.0)).otherwise(F.lit(0.0))


def split_power_toughness(text: Column) -> Column:
    """struct(power, toughness) at the first slash, blanks as null."""
    return F.struct(blank_to_null(F.split_part(text, F.lit("/"), F.lit(1))).alias("power"), blank_to_null(F.regexp_extract(text, r"(?s)^[^/]*/(.*)$", 1)).alias("toughness"))


def usable_rules_text(text: Column) -> Column:
    return F.when(F.char_length(F.trim(text)) >= 12, F.trim(text))


def is_short_token(text: Column) -> Column:
    return F.coalesce(F.char_length(F.trim(text)).between(1, 8), F.lit(False))


def lenient_decimal(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), ",", "").try_cast("decimal(12,2)")


def strict_date(text: Column) -> Column:
    return F.try_to_date(text, "yyyy-MM-dd")


def set_icon_key(code: Column) -> Column:
    return F.concat(F.lit("sets/"), code, F.lit("/icon.png"))


def printing_key(printing: Column, kind: str, face: Column | None = None) -> Column:
    """printings/<id>[/face<n>]/<kind>.jpg; kind: normal or art_crop."""
    side = F.lit("") if face is None else F.concat(F.lit("/face"), face.cast("string"))
    return F.concat(F.lit("printings/"), printing.cast("string"), side, F.lit(f"/{kind}.jpg"))


def scan_object_key(owner: Column, at: Column, scan_id: Column, media_type: Column) -> Column:
    """scans/<owner in lower case, '_' for all but letters and digits>/yyyy/MM/<id>.<extension>"""
    ext = F.when(media_type == "image/png", "png").when(media_type == "image/webp", "webp").otherwise("jpg")
    return F.concat(F.lit("scans/"), F.regexp_replace(F.lower(owner), r"[^\p{L}\p{N}]", "_"), F.date_format(at, "/yyyy/MM/"), scan_id, F.lit("."), ext)
