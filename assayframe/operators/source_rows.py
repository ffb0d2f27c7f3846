"""Rows of source text: which number is the value, which token its unit, what is the label, and what a reader has to look at.

All decisions are on places in the text. Numbers that overlap a range (`3.5 - 5.1`, `70 - <99`), method temperatures (`37 °C`) and, beside a number outside of ranges,
limits (`<5`) are no values; without such a number a limit is the value. A value must be the only one left. Its unit is the credible unit token
nearest to it, the one after it on a tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.numbers import comparator_value, reference_interval, unit
from ..functions.spans import BLANK, S, at, between, matches, overlaps, tightened, trimmed
from ..functions.text import CORE_RESULTS, alias_key
from .scans import durable

# The shapes of numbers, ranges and units in a line of a report.
LIMIT = "[<>≤≥]"
PLAIN = r"[+-]?(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:[.,]\d+)?|\.\d+)"
NUMBER = f"{LIMIT}?{S}*{PLAIN}"
REFERENCE = f"(?i)(?:{LIMIT}{S}*{PLAIN}|{PLAIN}{S}*(?:-|–|—|to){S}*{LIMIT}?{S}*{PLAIN})"
UNIT_PART = r"[\p{L}\p{M}\p{N}µμ⁰¹²³⁴⁵⁶⁷⁸⁹^+−]+"
UNIT = rf"(?iu)(?<![\p{{L}}-])(?:%|fL|{UNIT_PART}{S}*/{S}*{UNIT_PART})(?![\p{{L}}\p{{N}}])"
UNIT_BASES = ["bq", "cell", "cells", "copy", "copies", "eq", "g", "iu", "l", "mol", "osm", "pa", "u"]
UNIT_PREFIXES = ["", "y", "z", "a", "f", "p", "n", "µ", "u", "m", "c", "d", "da", "h", "k"]
METHOD_TEMPERATURE = rf"(?iu)^(?:30|37){S}*(?:°{S}*)?C\b|^(?:30|37){S}+degrees?"
FLAG = f"(?iu)(?:^|{S})(high|low|normal|abnormal|h|l|n)(?={S}|$)"

# The reasons why a row needs a review, and those that block its confirmation.
REVIEW_REASONS = [
    "missing-label", "missing-value", "unparseable-value", "unsupported-alias", "missing-unit", "incompatible-unit", "incompatible-specimen", "ambiguous-assay",
    "incompatible-method", "unparseable-reference-interval", "missing-collection-date", "ambiguous-date", "unsupported-layout", "defaulted-collection-date",
]
BLOCKING_REASONS = ["missing-label", "missing-value", "unparseable-value", "missing-unit", "incompatible-unit", "unsupported-layout"]


def numbers_in(text: Column) -> Column:
    """array<struct<raw, start, end, kind>>: numbers that are no part of a word and no method temperature."""

    def shaped(m: Column) -> Column:
        after = at(text, m["end"])
        word = r"^[\p{L}\p{N}]$"
        hyphenated = (after == "-") & at(text, m["end"] + 1).rlike(r"^\p{L}$")
        temperature = F.substring(text, m["start"] + 1, F.length(text)).rlike(METHOD_TEMPERATURE)
        return ~at(text, m["start"] - 1).rlike(word) & ~after.rlike(word) & ~hyphenated & ~temperature

    found = F.filter(F.transform(matches(text, NUMBER), tightened), shaped)
    return F.transform(found, lambda m: F.struct(m["raw"].alias("raw"), m["start"].alias("start"), m["end"].alias("end"), comparator_value(m["raw"])["kind"].alias("kind")))


def references_in(text: Column) -> Column:
    """array<struct<raw, start, end, is_range>>: ranges and limits."""
    return F.transform(matches(text, REFERENCE), lambda m: F.struct(trimmed(m["raw"]).alias("raw"), m["start"].alias("start"), m["end"].alias("end"), (~trimmed(m["raw"]).rlike(f"^{LIMIT}")).alias("is_range")))


def values_of(numbers: Column, references: Column) -> Column:
    """struct<values, references>: the numbers that can be the row's value, and the references that count."""

    def chosen(x: Column) -> Column:
        numeric = lambda m: m["kind"] == "numeric"
        outside = F.exists(x["n"], lambda m: numeric(m) & ~F.exists(x["r"], lambda r: r["is_range"] & overlaps(m, r)))
        counting = F.filter(x["r"], lambda r: r["is_range"] | outside)
        free = F.filter(x["n"], lambda m: ~F.exists(counting, lambda r: overlaps(m, r)))
        return let(
            F.struct(F.filter(free, numeric).alias("plain"), F.filter(free, lambda m: m["kind"] == "bounded").alias("bounds"), counting.alias("references")),
            lambda y: F.struct(F.when(F.size(y["plain"]) > 0, y["plain"]).otherwise(y["bounds"]).alias("values"), y["references"].alias("references")),
        )

    return let(F.struct(numbers.alias("n"), references.alias("r")), chosen)


def _is_unit_part(part: Column) -> Column:
    known = [p + b for p in UNIT_PREFIXES for b in UNIT_BASES]
    return let(F.lower(F.replace(trimmed(part), F.lit("μ"), F.lit("µ"))), lambda p: p.rlike(r"^\d+(?:\^[-+]?\d+|[⁰¹²³⁴⁵⁶⁷⁸⁹]+)$") | p.isin(known))


def unit_of(text: Column, values: Column) -> Column:
    """The unit token as written: credible, not inside a path, a percent sign only next to a value; the nearest to a single value, else the first."""
    blank = lambda a, b: ~between(text, a, b).rlike(f"[^{BLANK}]")

    def credible(m: Column) -> Column:
        parts = F.split(m["raw"], f"{S}*/{S}*")
        shape = (m["raw"] == "%") | (F.lower(m["raw"]) == "fl") | ((F.size(parts) == 2) & F.forall(parts, _is_unit_part))
        beside = F.exists(values, lambda v: ((m["start"] >= v["end"]) & blank(v["end"], m["start"])) | ((m["end"] <= v["start"]) & blank(m["end"], v["start"])))
        return shape & (at(text, m["start"] - 1) != "/") & ((m["raw"] != "%") | beside)

    def ranked(m: Column) -> Column:
        v = F.get(values, F.lit(0))
        alone, behind, ahead = F.size(values) == 1, m["start"] >= v["end"], m["end"] <= v["start"]
        far = F.when(alone & behind, m["start"] - v["end"]).when(alone & ahead, v["start"] - m["end"]).otherwise(0)
        return F.struct(far.alias("far"), F.when(alone & ~behind & ahead, 1).otherwise(0).alias("before"), m["start"].alias("start"), (-F.length(m["raw"])).alias("shortness"), m["raw"].alias("raw"))

    return F.array_min(F.transform(F.filter(matches(text, UNIT), credible), ranked))["raw"]


def read_rows(rows: DataFrame, text_col: str, aliases: DataFrame | None = None, unsafe: DataFrame | None = None, *, repeated: bool = False) -> DataFrame:
    """rows with label, value, value_kind, unit, reference, flag (texts, null where there is none), n_values, n_references, entry_id, n_entries and is_unsafe.

    value is null unless exactly one number, or else one qualitative result at the end, can be it. The label is what stands before the value, all of the text
    if there is none; where one entry's alias is in the text, it is that alias as written, with what stands in brackets right behind it. aliases and
    unsafe (entry_id, alias): without aliases entry_id is null and n_entries 0. is_unsafe: an unsafe alias of the entry, or of any where
    none was found, is in the text. A null text counts as empty. Columns of rows with these names are replaced.

    With aliases, or where texts are `repeated`, each different text is read once and joined to its rows.
    """
    own = ["label", "value", "value_kind", "unit", "reference", "flag", "n_values", "n_references", "entry_id", "n_entries", "is_unsafe"]
    kept = [c for c in rows.columns if c not in own]
    if repeated or aliases is not None:
        texts = rows.select(F.col(text_col).alias("_text")).distinct()
        if aliases is not None:
            texts = durable(texts)
        read = _read_texts(texts, "_text", aliases, unsafe).select(F.xxhash64("_text").alias("_id"), "_text", *own)
        rows = rows.select(*kept)
        return rows.join(read, (F.xxhash64(rows[text_col]) == read["_id"]) & rows[text_col].eqNullSafe(read["_text"]), "left").select(*[rows[c] for c in kept], *[read[c] for c in own])
    return _read_texts(rows.select(*kept), text_col, None, None)


def _read_texts(rows: DataFrame, text_col: str, aliases: DataFrame | None, unsafe: DataFrame | None) -> DataFrame:
    kept = rows.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    staged = rows.withColumn("_x", values_of(numbers_in(text), references_in(text)))
    staged = staged.withColumn("_only", F.when(F.size("_x.values") == 1, F.get("_x.values", F.lit(0))))
    words = "|".join(sorted(CORE_RESULTS, key=len, reverse=True))
    said = F.when(F.col("_only").isNull(), F.nullif(F.regexp_extract(text, rf"(?iu)(?:^|{S})({words}){S}*$", 1), F.lit("")))
    staged = staged.withColumn("_said", said)
    start = F.coalesce(F.col("_only.start"), F.length(text) - F.length(F.regexp_extract(text, rf"(?iu)(?:^|{S})(?:{words}){S}*$", 0)))
    value = F.coalesce("_only.raw", "_said")
    before = F.when(value.isNotNull() & (start > 0), trimmed(between(text, F.lit(0), start))).otherwise(F.lit(""))
    kind = F.when(F.col("_only").isNotNull(), F.col("_only.kind")).when(F.col("_said").isNotNull(), "categorical").otherwise("free_text")
    read = staged.select(
        *[F.col(c) for c in kept], F.nullif(F.when(before != "", before).otherwise(text), F.lit("")).alias("label"), value.alias("value"), kind.alias("value_kind"), unit_of(text, F.col("_x.values")).alias("unit"),
        F.get("_x.references", F.lit(0))["raw"].alias("reference"), F.nullif(F.regexp_extract(text, FLAG, 1), F.lit("")).alias("flag"), F.size("_x.values").alias("n_values"), F.size("_x.references").alias("n_references"),
    )
    if aliases is None:
        return read.select("*", F.lit(None).cast("string").alias("entry_id"), F.lit(0).cast("long").alias("n_entries"), F.lit(False).alias("is_unsafe"))
    texts = read.select(F.xxhash64(text_col).alias("id"), F.col(text_col).alias("t")).where("t is not null")
    found = alias_matches(texts, aliases).withColumnsRenamed({"id": "_id", "t": "_t"})
    n_entries = F.coalesce("n_entries", F.lit(0)).cast("long")
    known = read.join(found, (F.xxhash64(read[text_col]) == found["_id"]) & (read[text_col] == found["_t"]), "left").drop("_id", "_t")
    if unsafe is None:
        known = known.withColumn("is_unsafe", F.lit(False))
    else:
        risky = alias_hits(texts, unsafe).groupBy(F.col("id").alias("_id"), F.col("t").alias("_t")).agg(F.collect_set("entry_id").alias("_risks"))
        known = known.join(risky, (F.xxhash64(known[text_col]) == risky["_id"]) & (known[text_col] == risky["_t"]), "left").drop("_id", "_t")
        known = known.withColumn("is_unsafe", F.coalesce(F.when(F.col("entry_id").isNull(), F.size("_risks") > 0).otherwise(F.array_contains("_risks", F.col("entry_id"))), F.lit(False)))
    safe = ~F.col("is_unsafe") & (n_entries == 1)
    label = F.when(safe, F.col("alias_text")).otherwise(F.col("label"))
    return known.select(*kept, label.alias("label"), "value", "value_kind", "unit", "reference", "flag", "n_values", "n_references", F.when(safe, F.col("entry_id")).alias("entry_id"), n_entries.alias("n_entries"), "is_unsafe")


def alias_hits(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, t, entry_id, start, end, n_words, n_chars): where aliases (entry_id, alias) occur in texts (id, t) as whole words, without regard to case, accents and punctuation.

    A text's words meet aliases in an equi-join on an alias's first word; the words that follow are compared then, by their places.
    """
    spelt = aliases.select("entry_id", alias_key(F.col("alias")).alias("key")).where("key <> ''").distinct().withColumn("words", F.split("key", " "))
    words = F.transform(matches(F.col("t"), r"[\p{L}\p{M}\p{N}]+"), lambda m: F.struct(alias_key(m["raw"]).alias("key"), m["start"].alias("start"), m["end"].alias("end")))
    listed = texts.withColumn("_w", words)
    at_first = listed.select("id", "t", "_w", F.posexplode("_w").alias("i", "w"))
    met = at_first.join(spelt.withColumn("_first", F.get("words", F.lit(0))), F.col("w.key") == F.col("_first"))
    run = F.slice("_w", F.col("i") + 1, F.size("words"))
    last = F.get("_w", F.col("i") + F.size("words") - 1)
    met = met.where(F.transform(run, lambda x: x["key"]) == F.col("words"))
    return met.select("id", "t", "entry_id", F.col("w.start").alias("start"), last["end"].alias("end"), F.size("words").alias("n_words"), F.length("key").alias("n_chars"))


def alias_matches(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, t, entry_id, alias_text, n_entries): the leftmost, then longest alias in each text that has any, and how many entries have one in it."""
    hits = alias_hits(texts, aliases)
    closing = F.locate(")", F.substring(F.col("t"), F.col("end") + 1, F.length("t")))
    end = F.when((at(F.col("t"), F.col("end")) == "(") & (closing > 0), F.col("end") + closing).otherwise(F.col("end"))
    best = F.min(F.struct("start", (-F.col("n_chars")).alias("shortness"), (end - F.col("start")).alias("size"), "entry_id", end.alias("end"))).alias("b")
    found = hits.groupBy("id", "t").agg(best, F.count_distinct("entry_id").alias("n_entries"))
    return found.select("id", "t", "b.entry_id", between(F.col("t"), F.col("b.start"), F.col("b.end")).alias("alias_text"), "n_entries")


def review_reasons(rows: DataFrame, entries: DataFrame, *, date: Column, date_defaulted: Column | None = None, date_ambiguous: Column | None = None, specimen: Column | None = None, method_ok: Column | None = None) -> DataFrame:
    """rows of read_rows() with `reasons`, those of REVIEW_REASONS that hold, in that order. entries (entry_id, units, specimens): those of null fit everything.

    A null specimen or date means unknown; method_ok null means that the entry asks for no method.
    """
    no, yes = (lambda c: F.coalesce(c, F.lit(False))), (lambda c: F.coalesce(c, F.lit(True)))
    own = F.col("unit")
    spelt = unit(own)
    e = entries.select(F.col("entry_id").alias("_entry"), F.transform("units", unit).alias("_units"), F.col("specimens").alias("_specimens"))
    known = rows.join(e, rows["entry_id"] == e["_entry"], "left")
    several, value = F.col("n_entries") > 1, F.col("value")
    unclear = F.col("is_unsafe") | several
    false = F.lit(False)
    holds = {
        "missing-label": F.col("label").isNull(), "missing-value": value.isNull(), "unparseable-value": F.col("value_kind") == "free_text", "unsupported-alias": F.col("entry_id").isNull(),
        "missing-unit": own.isNull() & F.col("value_kind").isin("numeric", "bounded"), "incompatible-unit": ~yes(F.array_contains("_units", spelt)),
        "incompatible-specimen": false if specimen is None else ~yes(F.array_contains("_specimens", specimen)), "ambiguous-assay": unclear, "incompatible-method": false if method_ok is None else ~unclear & ~yes(method_ok),
        "unparseable-reference-interval": F.col("reference").isNotNull() & reference_interval(F.col("reference")).isNull(), "missing-collection-date": date.isNull(),
        "ambiguous-date": false if date_ambiguous is None else no(date_ambiguous), "unsupported-layout": (F.col("n_values") > 1) | (F.col("n_references") > 1) | several,
        "defaulted-collection-date": false if date_defaulted is None else date.isNotNull() & no(date_defaulted),
    }
    return known.withColumn("reasons", F.array_compact(F.array(*[F.when(holds[r], r) for r in REVIEW_REASONS]))).drop("_entry", "_units", "_specimens")


def is_measurement_shaped(text: Column) -> Column:
    """Of rows of read_rows(): a label of two characters or more, and a known entry with a digit in the text, or a value that is qualitative or has an entry, a unit or a reference."""
    shaped = F.col("value").isNotNull() & (F.col("value_kind") != "free_text") & ((F.col("value_kind") == "categorical") | F.col("entry_id").isNotNull() | F.col("unit").isNotNull() | reference_interval(F.col("reference")).isNotNull())
    return (F.length(trimmed(F.coalesce("label", F.lit("")))) >= 2) & ((F.col("entry_id").isNotNull() & text.rlike(r"\d")) | shaped)


def blocks_confirmation(reasons: Column, decision: Column) -> Column:
    """A row that is not skipped and has a blocking reason."""
    return (decision != "skip") & F.arrays_overlap(reasons, F.array(*[F.lit(r) for r in BLOCKING_REASONS]))


def default_decision(reasons: Column) -> Column:
    """`resolve` where nothing but a defaulted date is to be looked at, else `unresolved`: no row goes without a person's decision."""
    return F.when(F.size(F.array_remove(reasons, "defaulted-collection-date")) == 0, "resolve").otherwise("unresolved")


def display_labels(labels: DataFrame, aliases: DataFrame, *, label: str = "label", value: str = "value", unit_col: str = "unit", reference: str = "reference", flag: str = "flag") -> DataFrame:
    """labels with `display`: the label without a suffix that repeats its own value, unit, reference or flag.

    Suffixes are taken off word by word from the end, each field once and in any order, each as what it means (numbers by their value, units by their
    spelling, a flag by its letters). The most fields that leave a text with aliases of exactly one entry count; if that gives several texts, or none,
    or the row has neither value nor reference, the label stays. At most four fields, so at most four rounds, each of which looks at the words left.
    """
    numbers = lambda c: F.transform(F.transform(matches(c, NUMBER), lambda m: trimmed(m["raw"])), comparator_value)
    own = [label, value, unit_col, reference, flag]
    # Rows alike in label and fields are decided once; their key is a struct of all five.
    alike = labels.select(*own).distinct()
    said = alike.select(
        F.struct(*own).alias("_key"), trimmed(F.col(label)).alias("_label"), F.col(value).alias("_v"), F.col(unit_col).alias("_u"), F.col(reference).alias("_r"), F.col(flag).alias("_f")
    ).where("_label <> '' AND (nullif(_v, '') IS NOT NULL OR nullif(_r, '') IS NOT NULL)")
    same = lambda a, b: (a["kind"] == b["kind"]) & a["comparator"].eqNullSafe(b["comparator"]) & a["num"].eqNullSafe(b["num"]) & alias_key(a["text"]).eqNullSafe(alias_key(b["text"]))
    part = F.col("_part")
    fits = {
        "value": (F.col("_v") != "") & same(comparator_value(part), comparator_value(F.col("_v"))),
        "unit": (F.col("_u") != "") & (unit(part) == unit(F.col("_u"))),
        "reference": (F.col("_r") != "") & reference_interval(part).isNotNull() & (numbers(part) == numbers(F.col("_r"))),
        "flag": (F.col("_f") != "") & (alias_key(part) == alias_key(F.col("_f"))),
    }
    left = said.select("*", F.col("_label").alias("_rest"), F.array().cast("array<string>").alias("_taken"), F.array().cast("array<int>").alias("_cuts"))
    levels = []
    for _ in fits:  # each round is stored, as the next one and the result read it
        cut = left.withColumn("_gap", F.explode(F.transform(matches(F.col("_rest"), S), lambda m: m["end"])))
        cut = cut.withColumn("_part", trimmed(F.substring(F.col("_rest"), F.col("_gap") + 1, F.length("_rest")))).where("_part <> ''")
        taken = cut.withColumn("_kind", F.explode(F.array_compact(F.array(*[F.when(c & ~F.array_contains("_taken", k), k) for k, c in fits.items()]))))
        rest = trimmed(F.substring(F.col("_rest"), F.lit(1), F.col("_gap")))
        left = taken.select("_key", "_v", "_u", "_r", "_f", rest.alias("_rest"), F.array_append("_taken", F.col("_kind")).alias("_taken"), F.array_append("_cuts", F.col("_gap")).alias("_cuts")).where("_rest <> ''")
        left = durable(left.select("_key", "_rest", "_taken", "_cuts", "_v", "_u", "_r", "_f"))
        levels.append(left)
    every = levels[0].unionByName(levels[1]).unionByName(levels[2]).unionByName(levels[3])
    # of one order of fields, the reading whose fields are shortest from the end on
    every = every.groupBy("_key", "_taken").agg(F.max_by("_rest", "_cuts").alias("_rest")).withColumn("_n", F.size("_taken"))
    texts = every.select(F.xxhash64("_rest").alias("id"), F.col("_rest").alias("t")).distinct()
    only = alias_matches(texts, aliases).where("n_entries = 1").select(F.col("t").alias("_rest"))
    good = every.join(only, "_rest", "left_semi").groupBy("_key").agg(F.max(F.col("_n")).alias("_most"), F.collect_set(F.struct("_n", "_rest")).alias("_all"))
    best = good.select("_key", F.array_distinct(F.transform(F.filter("_all", lambda x: x["_n"] == F.col("_most")), lambda x: x["_rest"])).alias("_best"))
    best = best.select(F.xxhash64(*[F.col(f"_key.{c}") for c in own]).alias("_h"), "_key", F.when(F.size("_best") == 1, F.get("_best", F.lit(0))).alias("_display"))
    met = F.xxhash64(*[labels[c] for c in own]) == best["_h"]
    for c in own:
        met = met & labels[c].eqNullSafe(best["_key"][c])
    joined = labels.join(best, met, "left")
    return joined.withColumn("display", F.coalesce("_display", trimmed(F.col(label)))).drop("_h", "_key", "_display")
