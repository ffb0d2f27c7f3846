"""Numbers in laboratory text: decimals, comparators, intervals, units, and their display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

_SPACE = r"[\s  ]"
_NUMBER = r"[+-]?(?:\d[\d\s  .,]*|\.\d+)"

# Spellings of units, by their lower-case form.
UNIT_SPELLINGS = {
    "mg/dl": "mg/dL", "mg dl": "mg/dL", "mmol/l": "mmol/L", "mmol l": "mmol/L", "g/dl": "g/dL", "g/l": "g/L", "%": "%",
    "mmol/mol": "mmol/mol", "fl": "fL", "ng/ml": "ng/mL", "ug/l": "µg/L", "µg/l": "µg/L", "umol/l": "µmol/L", "µmol/l": "µmol/L",
    "nmol/l": "nmol/L", "pg/ml": "pg/mL", "pmol/l": "pmol/L", "u/l": "U/L", "l/l": "L/L",
}


def locale_decimal(text: Column) -> Column:
    """The double that text says: of comma and dot, the last is the decimal sign; a lone comma is one too. Else null."""

    def parsed(t: Column) -> Column:
        both = F.when(F.locate(",", F.reverse(t)) < F.locate(".", F.reverse(t)), F.regexp_replace(F.replace(t, F.lit("."), F.lit("")), "^([^,]*),", "$1.")).otherwise(F.replace(t, F.lit(","), F.lit("")))
        plain = F.when(t.contains(",") & t.contains("."), both).when(t.contains(","), F.regexp_replace(t, "^([^,]*),", "$1.")).otherwise(t)
        return let(plain, lambda p: F.when(p.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)$"), p.try_cast("double")))

    return let(F.regexp_replace(text, _SPACE, ""), parsed)


def comparator_value(text: Column) -> Column:
    """struct(kind, comparator, num, text): a number, a bound (<= reads as <), or free text; null for an empty text."""
    trimmed = F.btrim(text)
    pattern = rf"^([<>≤≥])?\s*({_NUMBER})\s*(.*)$"
    parts = F.struct(trimmed.alias("text"), trimmed.rlike(pattern).alias("shape"), F.regexp_extract(trimmed, pattern, 1).alias("sign"), locale_decimal(F.regexp_extract(trimmed, pattern, 2)).alias("num"))

    def value(v: Column) -> Column:
        bound = F.when(v["sign"].isin("<", "≤"), "<").when(v["sign"].isin(">", "≥"), ">")
        known = v["shape"] & v["num"].isNotNull()
        kind = F.when(~known, "free_text").when(bound.isNotNull(), "bounded").otherwise("numeric")
        return F.when(F.length(v["text"]) > 0, F.struct(kind.alias("kind"), F.when(known, bound).alias("comparator"), F.when(known, v["num"]).alias("num"), F.when(~known, v["text"]).alias("text")))

    return let(parts, value)


def scalar_value(text: Column, reference: Column) -> Column:
    """struct(kind, comparator, num, text) as in result tables: all six comparators stay distinct; a text is categorical only if
    it equals its reference."""
    pattern = r"^(<=|>=|<|>|≤|≥|=)?([+-]?\d+(?:[.,]\d+)?)$"

    def parted(compact: Column) -> Column:
        tight = F.regexp_replace(compact, r"\s+", "")
        num = F.replace(F.regexp_extract(tight, pattern, 2), F.lit(","), F.lit(".")).try_cast("double")
        sign = F.nullif(F.regexp_extract(tight, pattern, 1), F.lit(""))
        same = F.coalesce(F.lower(F.btrim(reference)) == F.lower(compact), F.lit(False)) & ~compact.rlike("[.!?;]")
        return F.struct(compact.alias("compact"), sign.alias("sign"), num.alias("num"), same.alias("same"))

    def value(x: Column) -> Column:
        # without a match num is null
        number, sign = x["num"].isNotNull(), x["sign"]
        bound = F.when(sign == "≤", "<=").when(sign == "≥", ">=").otherwise(sign)
        kind = F.when(number & sign.isNull(), "numeric").when(number, "bounded").when(x["same"], "categorical").otherwise("text")
        said = F.struct(kind.alias("kind"), F.when(number, bound).alias("comparator"), F.when(number, x["num"]).alias("num"), F.when(~number, x["compact"]).alias("text"))
        return F.when(F.length(x["compact"]) > 0, said)

    return let(let(F.btrim(F.regexp_replace(text, r"\s+", " ")), parted), value)


def reference_interval(text: Column) -> Column:
    """text, trimmed and otherwise as it is, if it has the shape of an interval or bound; else null."""
    trimmed = F.btrim(text)
    shape = rf"(?i)^(?:[<>≤≥]\s*)?{_NUMBER}(?:\s*(?:-|–|—|to)\s*[<>≤≥]?\s*{_NUMBER})?$"
    return F.when(trimmed.rlike(shape), trimmed)


def unit(text: Column) -> Column:
    """The usual spelling of a unit; an unknown one keeps its own, with white space in order. Null for an empty text."""
    neat = F.regexp_replace(F.regexp_replace(F.replace(F.btrim(text), F.lit("μ"), F.lit("µ")), r"\s*/\s*", "/"), r"\s+", " ")
    spellings = F.create_map(*[F.lit(x) for pair in UNIT_SPELLINGS.items() for x in pair])
    return F.when(F.length(neat) > 0, F.coalesce(F.try_element_at(spellings, F.lower(neat)), neat))


def unit_key(text: Column) -> Column:
    """What two spellings of a unit share: lower case, no white space."""
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def converted(value: Column, from_unit: Column, to_unit: Column, factor: Column, offset: Column) -> Column:
    """value in to_unit: as it is if the units are equal, else affine and rounded to 12 places; null without a factor."""
    return F.when(from_unit == to_unit, value).otherwise(F.round(value * factor + F.coalesce(offset, F.lit(0.0)), 12))


def number_text(value: Column) -> Column:
    """A double as text without a trailing `.0`."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def value_text(kind: Column, comparator: Column, num: Column, text: Column) -> Column:
    return F.when(kind == "numeric", number_text(num)).when(kind == "bounded", F.concat(comparator, number_text(num))).otherwise(text)


def four_digits(value: Column) -> Column:
    """value to four significant digits."""
    places = F.lit(3) - F.floor(F.log10(F.abs(value)))
    scale = F.pow(F.lit(10.0), places)
    return F.when(value == 0, F.lit(0.0)).otherwise(F.round(value * scale) / scale)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, zero where whole is zero or null."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def clamped(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def change(previous: Column, latest: Column) -> Column:
    return F.when(latest > previous, "increased").when(latest < previous, "decreased").when(latest == previous, "stable")
