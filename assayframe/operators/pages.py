"""Decisions about the pages of a report: which reader takes them, which header and result column own a row, what a model's answer is worth.

All but the centres of columns are joins, windows and expressions. A page's header cells are few, and their centres fold over them in order of x.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from .dedup import keep_first

# The fields of a row in a model's answer, and the limits of an answer.
ANSWER_FIELDS = ["label", "value", "unit", "reference_interval", "flag"]
MOST_ROWS, LONGEST_FIELD = 80, 512


def route_reason(n_observations: Column, source_text: Column, provenance: dict[str, tuple[Column, str]]) -> Column:
    """Why a page goes to the fast reader (`bound-selectable-text-source`) or not, the first reason that holds.

    provenance has what is known of the text's origin and what it must be, by name.
    """
    known = [have.isNotNull() for have, _ in provenance.values()]
    right = [have == want for have, want in provenance.values()]
    every = lambda conditions: F.forall(F.array(*conditions), lambda c: c)
    return (
        F.when(n_observations == 0, "empty-observations").when(source_text.isNotNull() & ~source_text.rlike(r"\S"), "empty-source-text")
        .when(source_text.isNull() | ~every(known), "mixed-or-unknown-provenance").when(~every(right), "no-selectable-text-provenance").otherwise("bound-selectable-text-source")
    )


def merged_readings(fast: DataFrame, fallback: DataFrame, deferred: DataFrame, page: list[str], content: list[str], row_id: str, order: list[str]) -> DataFrame:
    """Rows of the fast reader and, with `from_fallback`, those of the fallback on deferred pages that add something.

    Of fallback rows alike in `content` and page the first counts; of those that share an id the first again, unless a fast row has that id.
    """
    scoped = fallback.join(deferred.select(*page).distinct(), page, "left_semi")
    exact = keep_first(scoped, [*page, *content], order).drop("n_duplicates")
    first = keep_first(exact, [row_id], order).drop("n_duplicates")
    added = first.join(fast.select(row_id), row_id, "left_anti")
    return fast.withColumn("from_fallback", F.lit(False)).unionByName(added.select(*fast.columns).withColumn("from_fallback", F.lit(True)))


def owned_in_corridor(rows: DataFrame, keys: list[str], order: list[str], *, top: str, bottom: str, row_id: str, header_kind: str, in_table: Column, most_gap: float) -> DataFrame:
    """rows with `header_id`: the header row above them, null if it isn't a clear one (`column`) or a gap over most_gap lies between.

    header_kind is `absent` for rows that are no header. Gaps don't matter where in_table holds. One sort of each key's rows.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    gap = F.col(top) - F.lag(bottom).over(w)
    breaks = rows.withColumn("_gap", F.coalesce((gap > most_gap) & ~in_table, F.lit(False)).cast("long"))
    breaks = breaks.withColumn("_run", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    header = F.when(F.col(header_kind) != "absent", F.struct(F.col(row_id).alias("id"), F.col(header_kind).alias("kind"), F.col("_run").alias("run")))
    above = breaks.withColumn("_above", F.last(header, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    own = (F.col("_above.kind") == "column") & (F.col("_above.run") == F.col("_run"))
    return above.withColumn("header_id", F.when(own, F.col("_above.id"))).drop("_gap", "_run", "_above")


def _middle(values: Column) -> Column:
    """The median of a sorted array."""
    n = F.size(values)
    at = lambda i: F.get(values, i.cast("int"))
    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2


def column_centers(headers: DataFrame, page: list[str], x: str, tolerance: float) -> DataFrame:
    """(page, center): medians of runs of header cells, left to right; a cell joins the last run if it is within tolerance of that run's median."""

    def step(acc: Column, at: Column) -> Column:
        joins = F.abs(at - _middle(acc["run"])) <= tolerance
        begins = F.size(acc["run"]) == 0
        done = F.when(begins | joins, acc["done"]).otherwise(F.array_append(acc["done"], _middle(acc["run"])))
        return F.struct(F.when(joins, F.array_append(acc["run"], at)).otherwise(F.array(at)).alias("run"), done.alias("done"))

    none = F.array().cast("array<double>")
    folded = F.aggregate("_xs", F.struct(none.alias("run"), none.alias("done")), step, lambda acc: F.array_append(acc["done"], _middle(acc["run"])))
    return headers.groupBy(*page).agg(F.array_sort(F.collect_list(F.col(x).cast("double"))).alias("_xs")).select(*page, F.explode(folded).alias("center"))


def admitted_by_column(variants: DataFrame, centers: DataFrame, page: list[str], *, group: str, variant: str, x: str, tolerance: float, least_groups: int = 2) -> tuple[DataFrame, DataFrame]:
    """What the page's result columns say about groups of row variants, and the columns that count.

    The first has page, group, `outcome` and `variant`: a center counts if at least least_groups groups have a variant within tolerance of it. A page
    without one admits all its groups. Else a group with one variant at a center is admitted with that one, with several it is for review, and
    without any it is excluded. The second has page and center.
    """
    near = F.abs(F.col(x) - F.col("center")) <= tolerance
    met = variants.join(centers, page).where(near)
    counted = met.groupBy(*page, "center").agg(F.count_distinct(group).alias("_n")).where(F.col("_n") >= least_groups).select(*page, "center")
    hit = met.join(counted, [*page, "center"], "left_semi").groupBy(*page, group).agg(F.count_distinct(variant).alias("_hits"), F.min(variant).alias("_one"))
    held = counted.select(*page).distinct().withColumn("_held", F.lit(True))
    out = variants.select(*page, group).distinct().join(hit, [*page, group], "left").join(held, page, "left")
    outcome = F.when(F.col("_held").isNull(), "admitted").when(F.col("_hits").isNull(), "excluded").when(F.col("_hits") > 1, "review").otherwise("admitted")
    return out.select(*page, group, outcome.alias("outcome"), F.when(F.col("_hits") == 1, F.col("_one")).alias(variant)), counted


def unrepresented(anchors: DataFrame, represented: DataFrame, centers: DataFrame, page: list[str], *, row: str, x: str, tolerance: float) -> DataFrame:
    """(page, row, n_anchors): rows that no group stands for, although they have values at a column that counts."""
    alone = anchors.join(represented.select(*page, row), [*page, row], "left_anti").join(centers, page).where(F.abs(F.col(x) - F.col("center")) <= tolerance)
    return alone.select(*page, row, x, "center").groupBy(*page, row, x).agg(F.lit(1).alias("_n")).groupBy(*page, row).agg(F.count("*").alias("n_anchors"))


def associated(rows: DataFrame) -> DataFrame:
    """Of rows with label, value, unit, reference and n_values those that stand for a measurement, with `value_type`.

    They have one value outside ranges, a label, and a unit or a reference.
    """
    whole = (F.col("n_values") == 1) & F.col("label").isNotNull() & (F.col("unit").isNotNull() | F.col("reference").isNotNull())
    kind = F.when(F.col("value").rlike("^[<>≤≥]"), "bounded").otherwise("numeric")
    # A filter on columns that are long expressions would repeat these; one on what a generator gives can't be pushed into them.
    kept = rows.select(F.inline_outer(F.when(whole, F.array(F.struct(*rows.columns, kind.alias("value_type"))))))
    return kept.where(F.col("n_values").isNotNull())


def whole_json(text: Column) -> Column:
    """The variant that a text says as a whole; null for one with anything behind it, which the parser alone would pass over."""
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    alone = F.try_parse_json(F.concat(F.lit('{"w":'), text, F.lit("}"))).isNotNull()
    return let(listed, lambda found: F.when((F.size(found) == 1) & alone, F.get(found, F.lit(0))))


def decoded_answers(answers: DataFrame, raw: str) -> DataFrame:
    """answers with `error` (null if there is none) and `rows`, an array of structs of ANSWER_FIELDS; an answer counts as a whole or not at all.

    It must be a JSON object with `rows` only, at most MOST_ROWS objects with just ANSWER_FIELDS, each a string of at most LONGEST_FIELD characters or
    null; the label is not blank. Fields are trimmed, blank ones null. A null answer and one with a key twice are malformed.
    """
    as_map = lambda v: F.try_variant_get(v, "$", "map<string,variant>")  # noqa: E731 null for all but objects
    # The schema of an object says its keys, in their order, and their types at once.
    shape = "^OBJECT<" + ", ".join(f"{n}: (?:STRING|VOID)" for n in sorted(ANSWER_FIELDS)) + ">$"
    fields = "struct<" + ",".join(f"{n}:string" for n in ANSWER_FIELDS) + ">"

    def row(v: Column) -> Column:
        def judged(x: Column) -> Column:
            said = F.struct(*[F.nullif(F.btrim(x[n]), F.lit("")).alias(n) for n in ANSWER_FIELDS])
            short = F.forall(F.array(*[F.coalesce(F.length(x[n]), F.lit(0)) for n in ANSWER_FIELDS]), lambda n: n <= LONGEST_FIELD)
            return F.struct((short & (F.length(F.btrim(x["label"])) > 0)).alias("good"), said.alias("row"))

        shaped = F.coalesce(F.schema_of_variant(v).rlike(shape), F.lit(False))
        return F.when(shaped, let(F.try_variant_get(v, "$", fields), judged))

    def read(v: Column) -> Column:
        listed = let(as_map(v), lambda top: F.when((F.size(top) == 1) & F.map_contains_key(top, "rows"), F.try_variant_get(F.try_element_at(top, F.lit("rows")), "$", "array<variant>")))
        return let(listed, lambda rows: F.struct(v.isNotNull().alias("json"), F.when(rows.isNotNull(), F.size(rows)).alias("n"), F.when(F.size(rows) <= MOST_ROWS, F.transform(rows, row)).alias("read")))

    def decided(x: Column) -> Column:
        bad = F.array_position(F.transform(x["read"], lambda r: F.coalesce(r["good"], F.lit(False))), False)
        error = (
            F.when(~x["json"], "malformed-json").when(x["n"].isNull(), "malformed-envelope").when(x["n"] > MOST_ROWS, "too-many-rows")
            .when(bad > 0, F.concat(F.lit("row-"), (bad - 1).cast("string"), F.lit("-malformed")))
        )
        return let(error, lambda e: F.struct(e.alias("error"), F.when(e.isNull(), F.transform(x["read"], lambda r: r["row"])).alias("rows")))

    # What a generator gives is read once, whatever later steps and filters do with it.
    return answers.select(*[c for c in answers.columns if c not in ("error", "rows")], F.inline(F.array(let(let(whole_json(F.col(raw)), read), decided))))
