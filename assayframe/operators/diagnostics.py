"""What a diagnostics payload may say: a fixed shape, and at no depth a key that could hold health data or names of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pages import whole_json

# Keys that no part of a payload may have, in any case; keys and values of each part; categories of failures.
FORBIDDEN = "health healthdata payload records measurements biomarkers labels values units notes ocr prompt medication supplement intake filename path uri error message id".split()
PARTS = {"": ["schema", "app", "platform", "capabilities", "failures"], "app": ["version", "variant"], "platform": ["name", "osMajor"], "capabilities": ["localStorage", "protectedFiles"]}
VARIANTS, STATES = ["development", "preview", "production"], ["available", "unavailable", "unknown"]


def keys_of(json: Column) -> Column:
    """The keys of a JSON text at every depth, with repeats, as they are written."""
    strings = r'"((?:[^"\\]|\\.)*)"(\s*:)?'
    pairs = F.arrays_zip(F.regexp_extract_all(json, F.lit(strings), F.lit(1)).alias("k"), F.regexp_extract_all(json, F.lit(strings), F.lit(2)).alias("c"))
    return F.transform(F.filter(pairs, lambda p: p["c"] != ""), lambda p: p["k"])


def with_fault(payloads: DataFrame, raw: str, schema: str, categories: list[str]) -> DataFrame:
    """payloads with `fault`, the first that a payload has: not-json, forbidden-key, not-an-object, unknown-key, incomplete, wrong-schema, wrong-value or wrong-failure; null if it may be sent.

    The schema is a text, a version of the system a whole number from 1 or null. A null payload is no JSON.
    """
    v = F.col("_v")
    at = lambda path: F.try_variant_get(v, path, "variant")
    is_a = lambda x, kind: F.coalesce(F.schema_of_variant(x).startswith(kind), F.lit(False))
    text = lambda path: F.when(is_a(at(path), "STRING"), F.try_variant_get(v, path, "string"))
    keys = lambda path: F.map_keys(F.try_variant_get(v, path, "map<string,variant>"))
    staged = payloads.withColumn("_v", whole_json(F.col(raw)))
    whole = is_a(v, "OBJECT")
    known = F.lit(True)
    for part, allowed in PARTS.items():
        path = f"$.{part}" if part else "$"
        known = known & F.coalesce(F.size(F.array_except(keys(path), F.array(*[F.lit(k) for k in allowed]))) == 0, F.lit(True))
    complete = F.lit(True)
    for part in ("app", "platform", "capabilities"):
        complete = complete & is_a(at(f"$.{part}"), "OBJECT")
    major = at("$.platform.osMajor")
    os_fits = (F.array_contains(keys("$.platform"), "osMajor") & (major.isNull() | is_a(major, "VOID"))) | (is_a(major, "BIGINT") & (F.try_variant_get(v, "$.platform.osMajor", "bigint") >= 1))
    values = (text("$.platform.name") == "ios") & text("$.app.version").isNotNull() & text("$.app.variant").isin(VARIANTS) & os_fits & text("$.capabilities.localStorage").isin(STATES) & text("$.capabilities.protectedFiles").isin(STATES)
    failures = F.try_variant_get(v, "$.failures", "array<variant>")
    listed = is_a(at("$.failures"), "ARRAY") & F.forall(failures, lambda f: is_a(f, "STRING") & F.try_variant_get(f, "$", "string").isin(categories))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    fault = (
        F.when(v.isNull(), "not-json").when(F.exists(keys_of(F.col(raw)), lambda k: F.lower(k).isin(FORBIDDEN)), "forbidden-key").when(~whole, "not-an-object").when(no(known), "unknown-key").when(no(complete), "incomplete")
        .when(no(text("$.schema") == schema), "wrong-schema").when(no(values), "wrong-value").when(no(listed), "wrong-failure")
    )
    return staged.withColumn("fault", fault).drop("_v")
