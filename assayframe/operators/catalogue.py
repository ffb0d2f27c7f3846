"""The biomarker catalogue as small dimensions, and lookups against it.

Dimensions have a fixed, small number of rows that does not depend on the measurements, but nothing here forces a broadcast: Spark
broadcasts what is below its size threshold and shuffles what isn't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The fifteen biomarkers, their units and specimens, and conversions (from, to, factor, offset).
BIOMARKERS = [
    ("total_cholesterol", "mg/dL", ["mg/dL", "mmol/L"], [["blood", "serum", "plasma"], ["unknown"]]),
    ("ldl_c", "mg/dL", ["mg/dL", "mmol/L"], [["blood", "serum", "plasma"], ["unknown"]]),
    ("hdl_c", "mg/dL", ["mg/dL", "mmol/L"], [["blood", "serum", "plasma"], ["unknown"]]),
    ("triglycerides", "mg/dL", ["mg/dL", "mmol/L"], [["blood", "serum", "plasma"], ["unknown"]]),
    ("glucose", "mg/dL", ["mg/dL", "mmol/L"], [["blood"], ["serum", "plasma"]]),
    ("hba1c", "%", ["%", "mmol/mol"], [["blood"]]),
    ("ferritin", "ng/mL", ["ng/mL", "µg/L", "ug/L"], [["serum", "plasma"]]),
    ("vitamin_d_total", "ng/mL", ["ng/mL", "nmol/L"], [["serum"]]),
    ("vitamin_b12_total", "pg/mL", ["pg/mL", "pmol/L"], [["serum", "plasma"]]),
    ("hemoglobin", "g/dL", ["g/dL", "g/L"], [["blood"], ["unknown"]]),
    ("hematocrit", "%", ["%", "L/L"], [["blood"], ["unknown"]]),
    ("mcv", "fL", ["fL"], [["blood"], ["unknown"]]),
    ("alt", "U/L", ["U/L"], [["blood"], ["serum", "plasma"], ["unknown"]]),
    ("ast", "U/L", ["U/L"], [["blood"], ["serum", "plasma"], ["unknown"]]),
    ("ggt", "U/L", ["U/L"], [["blood"], ["serum", "plasma"], ["unknown"]]),
]
CONVERSIONS = [
    *[(b, "mmol/L", "mg/dL", 38.67, 0.0) for b in ("total_cholesterol", "ldl_c", "hdl_c")],
    *[(b, "mg/dL", "mmol/L", 1 / 38.67, 0.0) for b in ("total_cholesterol", "ldl_c", "hdl_c")],
    ("triglycerides", "mmol/L", "mg/dL", 88.57, 0.0),
    ("triglycerides", "mg/dL", "mmol/L", 1 / 88.57, 0.0),
    ("glucose", "mmol/L", "mg/dL", 1 / 0.0555, 0.0),
    ("glucose", "mg/dL", "mmol/L", 0.0555, 0.0),
    ("hba1c", "mmol/mol", "%", 0.09148, 2.152),
    ("hba1c", "%", "mmol/mol", 10.93, -23.5),
    *[("ferritin", a, b, 1.0, 0.0) for a in ("ng/mL", "µg/L", "ug/L") for b in ("ng/mL", "µg/L", "ug/L") if a != b],
    ("vitamin_d_total", "nmol/L", "ng/mL", 0.4, 0.0),
    ("vitamin_d_total", "ng/mL", "nmol/L", 2.5, 0.0),
    ("vitamin_b12_total", "pmol/L", "pg/mL", 1 / 0.738, 0.0),
    ("vitamin_b12_total", "pg/mL", "pmol/L", 0.738, 0.0),
    ("hemoglobin", "g/L", "g/dL", 0.1, 0.0),
    ("hemoglobin", "g/dL", "g/L", 10.0, 0.0),
    ("hematocrit", "L/L", "%", 100.0, 0.0),
    ("hematocrit", "%", "L/L", 0.01, 0.0),
]


def biomarkers(spark: SparkSession) -> DataFrame:
    """(biomarker_id, ordinal, canonical_unit, units, specimens)."""
    rows = [(b, i, unit, units, sorted({s for g in groups for s in g})) for i, (b, unit, units, groups) in enumerate(BIOMARKERS)]
    return spark.createDataFrame(rows, "biomarker_id string, ordinal int, canonical_unit string, units array<string>, specimens array<string>")


def unit_conversions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONVERSIONS, "biomarker_id string, from_unit string, to_unit string, factor double, offset double")


def unique_alias(rows: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """rows with entry_id: the one entry that has the alias `key`; null if none has it or several do. aliases (entry_id, key)."""
    only = aliases.groupBy(key).agg(F.min("entry_id").alias("lowest"), F.max("entry_id").alias("highest")).where("lowest = highest").select(key, F.col("lowest").alias("entry_id"))
    return rows.join(only, key, "left")


def first_alias(rows: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """rows with entry_id: the first entry, by ordinal, that has the alias. aliases (entry_id, ordinal, key)."""
    return rows.join(aliases.groupBy(key).agg(F.min_by("entry_id", F.struct("ordinal", "entry_id")).alias("entry_id")), key, "left")


def aliases_in_text(texts: DataFrame, aliases: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, entry_id, alias, start): the best alias in each text, on token boundaries: the leftmost, then the longest, then the lowest entry.

    Each token, with those that follow it as far as the longest alias goes, meets the aliases that begin with it in an equi-join on that one token; what
    follows is compared then. aliases (entry_id, alias): lower case, single spaces, of any length.
    """
    longest = aliases.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 1
    tokens = F.split(F.btrim(F.regexp_replace(F.lower(F.col(text_col)), "[^a-z0-9]+", " ")), " ")
    here = lambda t: F.transform(t, lambda x, i: F.struct(i.alias("start"), x.alias("first"), F.array_join(F.slice(t, i + 1, F.lit(longest)), " ").alias("ahead")))
    # the array is bound to a variable of a lambda, lest it be computed anew for each token
    at = texts.select(F.col(id_col).alias("id"), F.explode(F.transform(F.array(tokens), here)[0]).alias("r")).select("id", "r.*")
    known = aliases.select("entry_id", "alias", F.split_part("alias", F.lit(" "), F.lit(1)).alias("first"))
    met = at.join(known, "first").where((F.col("ahead") == F.col("alias")) | F.startswith("ahead", F.concat("alias", F.lit(" "))))
    best = F.min(F.struct("start", (-F.length("alias")).alias("shortness"), "entry_id", "alias")).alias("b")
    return met.groupBy("id").agg(best).select("id", "b.entry_id", "b.alias", F.col("b.start").cast("long").alias("start"))


def method_profile(text: F.Column, profiles: F.Column) -> F.Column:
    """The id of the one profile of whose three pattern lists text has at least one each; null if none or several match.

    profiles: array<struct<profile_id, assay_patterns, temperature_patterns, cofactor_patterns>>.
    """
    has = lambda patterns: F.exists(patterns, lambda p: F.contains(F.lower(text), F.lower(p)))
    met = F.filter(profiles, lambda p: has(p["assay_patterns"]) & has(p["temperature_patterns"]) & has(p["cofactor_patterns"]))
    return F.when(F.size(met) == 1, F.get(met, F.lit(0))["profile_id"])


def applicable_guidance(contexts: DataFrame, guidance: DataFrame) -> DataFrame:
    """contexts ⋈ guidance on biomarker_id, population and jurisdiction; `all`, `any` and null in the guidance fit every context.

    A context with an unknown sex, fasting, purpose or specimen gets none.
    """
    c, g = contexts.alias("c"), guidance.alias("g")
    known = [F.coalesce(F.col(f"c.{x}") != "unknown", F.lit(True)) for x in ("sex", "fasting", "purpose", "specimen")]
    fits = lambda x, wild: (F.col(f"g.{x}") == wild) | (F.col(f"g.{x}") == F.col(f"c.{x}"))
    optional = lambda x: F.col(f"g.{x}").isNull() | (F.col(f"g.{x}") == F.col(f"c.{x}"))
    on = (F.col("c.biomarker_id") == F.col("g.biomarker_id")) & (F.col("c.population") == F.col("g.population")) & (F.col("c.jurisdiction") == F.col("g.jurisdiction"))
    met = c.join(g, on).where(fits("sex", "all") & fits("fasting", "any") & optional("purpose") & optional("specimen"))
    for k in known:
        met = met.where(k)
    return met.select("c.*", "g.guidance_id")


def release_issues(entries: DataFrame, aliases: DataFrame, conversions: DataFrame, wording: list[str]) -> DataFrame:
    """(issue, subject): what a catalogue release must not have; empty if it is fine.

    Aliases of two entries, conversions between units an entry doesn't have, entries without their canonical unit, repeated ids, and
    forbidden wording in labels.
    """
    from ..functions.text import forbidden_wording

    collisions = aliases.groupBy("alias_norm").agg(F.min("biomarker_id").alias("a"), F.max("biomarker_id").alias("b")).where("a <> b").select(F.lit("alias-collision").alias("issue"), F.col("alias_norm").alias("subject"))
    unknown = conversions.join(entries.select("biomarker_id", "units"), "biomarker_id", "left").where(~F.coalesce(F.array_contains("units", F.col("from_unit")) & F.array_contains("units", F.col("to_unit")), F.lit(False))).select(F.lit("conversion-unit").alias("issue"), F.concat_ws(":", "biomarker_id", "from_unit", "to_unit").alias("subject"))
    canonical = entries.where(~F.coalesce(F.array_contains("units", F.col("canonical_unit")), F.lit(False))).select(F.lit("canonical-unit").alias("issue"), F.col("biomarker_id").alias("subject"))
    repeated = entries.groupBy("biomarker_id").count().where("count > 1").select(F.lit("repeated-id").alias("issue"), F.col("biomarker_id").alias("subject"))
    orphans = aliases.join(entries, "biomarker_id", "left_anti").select(F.lit("alias-of-unknown").alias("issue"), F.col("alias_norm").alias("subject"))
    words = aliases.where(forbidden_wording(F.col("alias_norm"), wording).isNotNull()).select(F.lit("wording").alias("issue"), F.col("alias_norm").alias("subject"))
    return collisions.unionByName(unknown).unionByName(canonical).unionByName(repeated).unionByName(orphans).unionByName(words).distinct()
