"""What a model proposes for the rows of a page counts only if it refers to rows as they are and to known entries; anything else is dropped, never repaired.

batches (batch_id, raw): a JSON array of proposals, or an object with them under `proposals`. rows (batch_id, position, row_id, ids): the rows that the model was given, with the ids of
their cells. entries (biomarker_id). A proposal names its row by its number and cells by theirs (`rowKey`, `labelKey`, ...), or by the ids of all its cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pages import whole_json
from .scans import durable

#: Bounds of a batch: proposals, cells of a row, characters of an id.
MOST_PROPOSALS, MOST_CELLS, LONGEST_ID = 24, 24, 96

# Keys of a proposal in its two forms, fields, specimens and roles.
BY_NUMBER = ["rowKey", "labelKey", "valueKey", "unitKey", "referenceIntervalKey", "flagKey", "biomarkerId", "role", "specimenType"]
BY_IDS = ["sourceObservationIds", "sourceFields", "proposedBiomarkerId", "biomarkerId", "proposedSpecimenType", "specimenType", "role"]
FIELDS = ["label", "value", "unit", "referenceInterval", "flag"]
SPECIMENS = ["blood", "serum", "plasma", "urine", "stool", "saliva", "unknown", "other"]
ROLES = ["measurement", "preserve", "specimen-context", "ignore"]


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _map(v: Column) -> Column:
    return F.when(_is(v, "OBJECT"), F.try_variant_get(v, "$", "map<string,variant>"))


def _has(m: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.map_keys(m), key), F.lit(False))


def _text(m: Column, key: str) -> Column:
    """The string under key; null for anything else."""
    v = F.try_element_at(m, F.lit(key))
    return F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string"))


def _null(m: Column, key: str) -> Column:
    """Whether key is there with a JSON null."""
    return _has(m, key) & (F.try_element_at(m, F.lit(key)).isNull() | _is(F.try_element_at(m, F.lit(key)), "VOID"))


def _only(m: Column, keys: list[str]) -> Column:
    return F.size(F.array_except(F.map_keys(m), F.array(*[F.lit(k) for k in keys]))) == 0


def _short(ids: Column) -> Column:
    return F.size(ids).between(1, MOST_CELLS) & (F.size(F.array_distinct(ids)) == F.size(ids)) & F.forall(ids, lambda i: F.coalesce(F.length(i).between(1, LONGEST_ID), F.lit(False)))


def given_rows(rows: DataFrame) -> DataFrame:
    """(batch_id, number, row_id, ids) of batches all of whose rows are in order: no id twice, none empty or too long, no cell in two rows."""
    odd = rows.where(~F.coalesce(_short(F.col("ids")) & F.length("row_id").between(1, LONGEST_ID), F.lit(False))).select("batch_id")
    twice = rows.groupBy("batch_id", "row_id").count().where("count > 1").select("batch_id")
    shared = rows.select("batch_id", F.explode("ids").alias("i")).groupBy("batch_id", "i").count().where("count > 1").select("batch_id")
    bad = odd.unionAll(twice).unionAll(shared).distinct()
    return rows.join(bad, "batch_id", "left_anti").select("batch_id", (F.row_number().over(Window.partitionBy("batch_id").orderBy("position", "row_id")) - 1).alias("number"), "row_id", "ids")


def valid_proposals(batches: DataFrame, rows: DataFrame, entries: DataFrame) -> DataFrame:
    """(batch_id, place, row_id, ids, label, value, unit, reference, flag, biomarker_id, specimen, role): the proposals that hold, place counting from 0 in the answer.

    Dropped are whole batches that are no JSON of that shape, have too many proposals or rows that aren't in order; single proposals with other keys, wrong
    types, unknown rows, cells or entries, a cell in two fields, no label or value among the fields, a biomarker that the role excludes or lacks, the role `ignore`; and all
    proposals of a row that several valid ones name.
    """
    # Answers alike are read once, and known by their SHA-256 from there on.
    answer = F.sha2("raw", 256).alias("answer")
    whole = batches.select(answer, "raw").where("raw IS NOT NULL").distinct().select("answer", whole_json(F.col("raw")).alias("v"))
    inner = F.try_variant_get("v", "$.proposals", "variant")
    listed = F.when(_is(F.col("v"), "ARRAY"), F.try_variant_get("v", "$", "array<variant>")).when(_is(F.col("v"), "OBJECT") & _is(inner, "ARRAY"), F.try_variant_get("v", "$.proposals", "array<variant>"))
    few = whole.withColumn("items", listed).select("answer", F.explode(F.when(F.size("items") <= MOST_PROPOSALS, F.transform("items", lambda v, i: F.struct(i.cast("long").alias("place"), v.alias("v"))))).alias("i"))
    m = F.col("m")
    items = few.select("answer", "i.place", _map(F.col("i.v")).alias("m")).where("m IS NOT NULL").withColumn("by_number", _text(m, "rowKey").isNotNull())

    # both ways to say the biomarker and the specimen, but not both at once
    one_of = lambda a, b: ~(_has(m, a) & _has(m, b))
    said = lambda a, b: (_text(m, a).isNotNull() | _null(m, a) | ~_has(m, a)) & (_text(m, b).isNotNull() | _null(m, b) | ~_has(m, b))
    biomarker, role = F.coalesce(_text(m, "proposedBiomarkerId"), _text(m, "biomarkerId")), _text(m, "role")
    named = lambda k: _text(m, k).isin(SPECIMENS) | ~_has(m, k)
    fits = one_of("proposedBiomarkerId", "biomarkerId") & one_of("proposedSpecimenType", "specimenType") & said("proposedBiomarkerId", "biomarkerId") & named("proposedSpecimenType") & named("specimenType")
    in_role = (~_has(m, "role")) | (role.isin(ROLES) & (role != "ignore") & ((role == "measurement") == biomarker.isNotNull()))
    items = items.where(F.coalesce(F.when(F.col("by_number"), _only(m, BY_NUMBER)).otherwise(_only(m, BY_IDS)) & fits & in_role, F.lit(False)))
    items = items.withColumns({"biomarker_id": biomarker, "specimen": F.coalesce(_text(m, "proposedSpecimenType"), _text(m, "specimenType")), "role": role})
    known = items.join(entries.select("biomarker_id").distinct().withColumn("_known", F.lit(True)), "biomarker_id", "left").where("biomarker_id IS NULL OR _known").drop("_known")
    # Stored: what batches share is small, and two branches read it.
    known = durable(known).join(batches.select("batch_id", answer), "answer").drop("answer")

    given = given_rows(rows)
    number = F.when(_text(m, "rowKey").rlike(r"^r(?:0|[1-9]\d*)$"), F.substring(_text(m, "rowKey"), 2, 20)).try_cast("int")
    by_number = known.where("by_number").withColumn("number", number).join(given, ["batch_id", "number"])
    cell = lambda k: F.get("ids", F.when(_text(m, k).rlike(r"^c(?:0|[1-9]\d*)$"), F.substring(_text(m, k), 2, 20)).try_cast("int"))
    picked = {f: cell(f"{f}Key") for f in FIELDS}
    complete = picked["label"].isNotNull() & picked["value"].isNotNull()
    for f in FIELDS[2:]:
        complete = complete & (picked[f].isNotNull() | _null(m, f"{f}Key"))
    by_number = by_number.where(complete).withColumn("fields", F.struct(*[c.alias(f) for f, c in picked.items()]))

    ids = F.try_variant_get(F.try_element_at(m, F.lit("sourceObservationIds")), "$", "array<variant>")
    texts = F.when(_is(F.try_element_at(m, F.lit("sourceObservationIds")), "ARRAY") & F.forall(ids, lambda v: _is(v, "STRING")), F.transform(ids, lambda v: F.try_variant_get(v, "$", "string")))
    by_ids = known.where("NOT by_number").withColumn("named", texts).where("named IS NOT NULL").withColumn("h", F.xxhash64("named"))
    by_ids = by_ids.join(given.withColumn("h", F.xxhash64("ids")), ["batch_id", "h"]).where("named = ids")
    f = _map(F.try_element_at(m, F.lit("sourceFields")))
    whole_fields = f.isNotNull() & (F.size(F.map_keys(f)) == len(FIELDS)) & _only(f, FIELDS) & _text(f, "label").isNotNull() & _text(f, "value").isNotNull()
    for k in FIELDS[2:]:
        whole_fields = whole_fields & (_text(f, k).isNotNull() | _null(f, k))
    by_ids = by_ids.where(F.coalesce(~_has(m, "sourceFields") | whole_fields, F.lit(False))).withColumn("fields", F.when(_has(m, "sourceFields"), F.struct(*[_text(f, k).alias(k) for k in FIELDS])))

    columns = ["batch_id", "place", "row_id", "ids", "fields", "biomarker_id", "specimen", "role"]
    both = by_number.select(*columns).unionByName(by_ids.select(*columns))
    used = F.array_compact(F.array(*[F.col(f"fields.{k}") for k in FIELDS]))
    own = both.where(F.col("fields").isNull() | ((F.size(F.array_distinct(used)) == F.size(used)) & (F.size(F.array_except(used, "ids")) == 0)))
    alone = own.withColumn("_n", F.count("*").over(Window.partitionBy("batch_id", "row_id"))).where("_n = 1")
    return alone.select(*columns[:4], *[F.col(f"fields.{k}").alias("reference" if k == "referenceInterval" else k) for k in FIELDS], *columns[5:])
