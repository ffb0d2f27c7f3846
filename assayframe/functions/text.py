"""Text: folding, identifiers, safe output, and closed vocabularies."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _single_folds() -> tuple[str, str]:
    """Letters below U+2000 that fold to one ASCII letter or digit when marks are dropped, and what they fold to."""
    pairs = []
    for code in range(0xA0, 0x2000):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not 0x300 <= ord(c) <= 0x36F).lower()
        if len(base) == 1 and base.isascii() and base.isalnum():
            pairs.append((chr(code), base))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


_FROM, _TO = _single_folds()
_MARKS = r"[̀-ͯ]"


def fold(text: Column) -> Column:
    """Lower case without accents, for letters that decompose to a single one; stays in generated code."""
    return F.translate(F.lower(F.regexp_replace(text, _MARKS, "")), _FROM, _TO)


def alias_key(text: Column) -> Column:
    """What spellings of a label share: folded, everything but letters, digits and hyphens a single space."""
    dashes = F.regexp_replace(fold(text), "[‐-―−]", "-")
    return F.btrim(F.regexp_replace(F.regexp_replace(dashes, "[^a-z0-9]+", " "), " +", " "))


@F.pandas_udf(StringType())
def alias_key_exact(text: pd.Series) -> pd.Series:
    """alias_key with the whole NFKD, also where a character decomposes to several; Spark has no such function."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        plain = "".join(c for c in unicodedata.normalize("NFKD", x) if not 0x300 <= ord(c) <= 0x36F).lower()
        return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in plain).split())

    return text.map(one, na_action="ignore").where(text.notna(), None)


def neat(text: Column, lower: bool = False) -> Column:
    """Trimmed, with single spaces."""
    out = F.btrim(F.regexp_replace(text, r"\s+", " "))
    return F.lower(out) if lower else out


def is_canonical_id(text: Column) -> Column:
    return text.rlike("^[a-z0-9]+(?:[._-][a-z0-9]+)*$")


def safe_token(text: Column) -> Column:
    """text if it is a short plain token, else `redacted`."""
    return F.when(text.rlike("^[a-zA-Z0-9._-]{1,80}$"), text).otherwise("redacted")


def csv_cell(text: Column) -> Column:
    """A quoted CSV cell; a mark that begins a formula, after white space maybe, gets an apostrophe right before it; null is NULL without quotes."""
    harmless = F.regexp_replace(text, r"^([\s\uFEFF]*)([=+\-@])", "$1'$2")
    return F.coalesce(F.concat(F.lit('"'), F.replace(harmless, F.lit('"'), F.lit('""')), F.lit('"')), F.lit("NULL"))


def file_size(size: Column) -> Column:
    """Bytes as B, KB or MB, by 1024, with one decimal from KB on."""
    shown = lambda n, unit: F.concat(F.format_string("%.1f", n), F.lit(f" {unit}"))
    return F.when(size < 0, F.lit(None)).when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024 * 1024, shown(size / 1024, "KB")).when(size.isNotNull(), shown(size / 1024 / 1024, "MB"))


# Words for specimens in the languages of reports.
SPECIMEN_WORDS = {
    "plasma": r"\bplasma\b",
    "serum": r"\b(?:serum|sérum|serumas)\b",
    "urine": r"\b(?:urine|urin|orina|urina)\b",
    "blood": r"\b(?:blood|whole blood|blut|vollblut|sang|sangue|bloed|krew|kraujas|kraujo)\b",
}


def specimen(text: Column) -> Column:
    """The one specimen that text names, in any case; `unknown` if it names none or several."""
    low = F.lower(text)
    named = F.array_compact(F.array(*[F.when(low.rlike(p), name) for name, p in SPECIMEN_WORDS.items()]))
    return F.when(F.size(named) == 1, F.get(named, F.lit(0))).otherwise("unknown")


def is_label_candidate(text: Column) -> Column:
    """Short text with a letter and no sentence marks, which is no date, unit, range or flag."""
    words = F.size(F.split(F.btrim(text), r"\s+"))
    return (F.length(text) <= 96) & (words <= 8) & text.rlike(r"\p{L}") & ~text.rlike("[.!?;:]") & ~text.rlike(r"^\d{1,4}[./-]\d{1,2}[./-]\d{1,4}$") & ~F.lower(F.btrim(text)).isin("h", "l", "high", "low", "normal", "mg/dl", "mmol/l", "g/l", "g/dl", "%", "u/l")


def forbidden_wording(text: Column, patterns: list[str]) -> Column:
    """The first of patterns that text matches."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(p)) for p in patterns])


def version_triple(text: Column) -> Column:
    """`1.10.2` as an array of numbers, which compares as versions do."""
    return F.transform(F.split(F.regexp_extract(text, r"^(\d+\.\d+\.\d+)", 1), r"\."), lambda x: x.try_cast("int"))


def contains_any(fields: list[Column], needle: Column) -> Column:
    """Whether one of several nullable fields has needle, in any case; an empty needle is in all."""
    return F.contains(F.lower(F.concat_ws("\u0001", *fields)), F.lower(F.btrim(needle)))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of a canonical JSON of columns, nulls included."""
    return F.sha2(canonical_json(*columns), 256)


def canonical_json(*columns: Column) -> Column:
    """JSON with the given columns in their order, nulls kept; name them in alphabetical order."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def header_key(text: Column) -> Column:
    """What spellings of a header share: folded, a space between a letter and the digit after it, all else but letters and digits a single space."""
    split = F.regexp_replace(fold(text), r"(?<=\p{L})(?=\p{N})", " ")
    return F.btrim(F.regexp_replace(split, r"[^\p{L}\p{N}]+", " "))


# Qualitative results that may end a line, and further ones that only count as a whole cell.
CORE_RESULTS = [
    "not detected", "positive", "negative", "detected", "normal", "abnormal", "nicht nachgewiesen", "nicht nachweisbar", "nachgewiesen", "positiv", "negativ", "auffällig", "unauffällig",
    "teigiamas", "neigiamas", "aptikta", "neaptikta", "nenustatyta", "normalus", "nenormalus",
]
CELL_RESULTS = [
    "present", "absent", "reactive", "non-reactive", "non reactive", "nonreactive", "susceptible", "sensitive", "resistant", "intermediate", "growth", "no growth", "equivocal", "borderline",
    "vorhanden", "nicht vorhanden", "reaktiv", "nicht reaktiv", "sensibel", "empfindlich", "resistent", "intermediär", "intermediaer", "wachstum", "kein wachstum", "grenzwertig",
]


def is_qualitative(cell: Column) -> Column:
    """Whether a whole cell is a qualitative result; null for null."""
    return F.lower(F.btrim(cell)).isin(CORE_RESULTS + CELL_RESULTS)


def qualitative_suffix(line: Column) -> Column:
    """The qualitative result that ends a line, as written, the longest one where several do; null if none does."""
    found = F.regexp_extract(line, r"(?iu)(?:^|\s)(" + "|".join(sorted(CORE_RESULTS, key=len, reverse=True)) + r")\s*$", 1)
    return F.nullif(found, F.lit(""))
