"""Rows of a report from positioned text: lines, columns, headers, dates and candidate rows.

Everything is keyed by report and page. Lines and columns are folds over a page (see clustering.py); header ownership is an as-of window,
column ownership an interval join, roles and reasons are expressions. Observations: report_id, page_index, observation_id, text, x, y, width, height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, numbers
from ..functions.text import is_label_candidate
from .clustering import anchored_lines, reading_order, running_midpoint_anchors

PAGE = ["report_id", "page_index"]


def lattice(observations: DataFrame, column_tolerance: float = 0.04) -> DataFrame:
    """observations with `line` and `column`, both from 1, per page; the same for any order of the input."""
    centered = observations.withColumn("cy", F.col("y") + F.col("height") / 2)
    lines = anchored_lines(centered, PAGE, "cy", "height", "observation_id", 0.75)
    return running_midpoint_anchors(lines, PAGE, "x", "observation_id", column_tolerance).drop("cy")


def page_text(cells: DataFrame) -> DataFrame:
    return reading_order(cells, PAGE, "line", "x", "text")


def roles(cells: DataFrame) -> DataFrame:
    """cells with `role`: value, unit, reference, flag or label, by the shape of the text; null for none."""
    text = F.btrim("text")
    value = numbers.comparator_value(text)
    unit_like = F.lower(F.regexp_replace(text, r"\s+", "")).isin(*[u.replace(" ", "") for u in numbers.UNIT_SPELLINGS])
    role = (
        F.when(text.rlike(r"(?i)^(h|l|high|low|hoch|tief|\*|\+|-)$"), "flag")
        .when(unit_like, "unit")
        .when(text.rlike(r"\d\s*(?:-|–|—|to)\s*[<>≤≥]?\s*\d") & numbers.reference_interval(text).isNotNull(), "reference")
        .when(value["kind"].isin("numeric", "bounded") & text.rlike(r"^[<>≤≥]?\s*[+-]?[\d.,\s]+$"), "value")
        .when(is_label_candidate(text), "label")
    )
    return cells.withColumn("role", role)


def row_candidates(cells: DataFrame) -> DataFrame:
    """(page, line, label, value, unit, reference, flag, review_reasons): a row for each line; a role that several cells have is ambiguous and null."""
    one = lambda r: F.when(F.count(F.when(F.col("role") == r, 1)) == 1, F.max(F.when(F.col("role") == r, F.col("text"))))
    many = lambda r: F.count(F.when(F.col("role") == r, 1)) > 1
    names = ("label", "value", "unit", "reference", "flag")
    rows = cells.groupBy(*PAGE, "line").agg(*[one(r).alias(r) for r in names], *[many(r).alias(f"_{r}") for r in names])
    reasons = F.array_compact(
        F.array(
            F.when(F.col("_label"), "ambiguous-label"), F.when(F.col("_value"), "ambiguous-value"), F.when(F.col("_unit"), "ambiguous-unit"),
            F.when(F.col("label").isNull() & ~F.col("_label"), "missing-label"), F.when(F.col("value").isNull() & ~F.col("_value"), "missing-value"), F.when(F.col("unit").isNull() & ~F.col("_unit"), "missing-unit"),
        )
    )
    return rows.select(*PAGE, "line", *names, reasons.alias("review_reasons"))


def blocking(reasons: Column) -> Column:
    """Whether a row must be looked at before it can be confirmed."""
    return F.exists(reasons, lambda r: r.isin("ambiguous-value", "missing-value", "ambiguous-label", "missing-label"))


def page_class(observations: DataFrame) -> DataFrame:
    """(page, page_class): laboratory-table, imaging-narrative or unknown."""
    t = F.lower("text")
    table = F.max(F.when(t.rlike(r"\b(reference range|result|ergebnis|rezultatas|mg/dl|mmol/l)\b"), 1).otherwise(0))
    image = F.max(F.when(t.rlike(r"\b(ultrasound|radiograph|mri|ct scan|findings|befund)\b"), 1).otherwise(0))
    return observations.groupBy(*PAGE).agg(table.alias("_t"), image.alias("_i")).select(*PAGE, F.when(F.col("_t") == 1, "laboratory-table").when(F.col("_i") == 1, "imaging-narrative").otherwise("unknown").alias("page_class"))


def admitted(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows that are not on imaging pages; pages of unknown class stay."""
    return rows.join(classes.where("page_class = 'imaging-narrative'"), PAGE, "left_anti")


def combined(fast: DataFrame, fallback: DataFrame, routes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the fast reader, and of the fallback those on deferred pages whose key the fast one doesn't have."""
    deferred = fallback.join(routes.where("route = 'deferred'"), PAGE, "left_semi").join(fast.select(*keys), keys, "left_anti")
    return fast.unionByName(deferred)


def specimen_of_rows(rows: DataFrame, headings: DataFrame) -> DataFrame:
    """rows with `specimen`: their own, else the one that their table's headings agree on, else the report's one, else unknown.

    rows (report_id, table_id, own), headings (report_id, table_id, specimen), a null table_id being the document's.
    """
    one = lambda keys, name: headings.where(F.col("specimen") != "unknown").groupBy(*keys).agg(F.when(F.min("specimen") == F.max("specimen"), F.min("specimen")).alias(name))
    out = rows.join(one(["report_id", "table_id"], "_table"), ["report_id", "table_id"], "left").join(one(["report_id"], "_doc"), "report_id", "left")
    return out.withColumn("specimen", F.coalesce("own", "_table", "_doc", F.lit("unknown"))).drop("_table", "_doc")


def is_permutation(pages: Column, order: Column) -> Column:
    """Whether a sanitization recipe's page order has each page once."""
    return F.array_sort(pages) == F.array_sort(order)


def bounded_chunks(rows: DataFrame, keys: list[str], order: str, payload: Column, limit: int) -> DataFrame:
    """(keys, block, json, n_bytes, rejected): rows as JSON arrays of at most `limit` bytes each, in order.

    A row that alone is over the limit is rejected: it comes by itself, block null, rejected true.
    """
    from .clustering import packed_blocks

    sized = rows.select(*keys, order, payload.alias("_json")).withColumn("_bytes", F.octet_length("_json") + 1).withColumn("_one", F.lit(""))
    blocks = packed_blocks(sized, keys, order, "_bytes", limit - 1, "_one")
    json = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_json"))), lambda r: r["_json"]), ","), F.lit("]"))
    single = F.when(F.col("block").isNull(), F.col(order))
    chunks = blocks.groupBy(*keys, "block", single.alias("_single")).agg(json.alias("json")).drop("_single")
    return chunks.withColumn("n_bytes", F.octet_length("json").cast("long")).withColumn("rejected", F.col("block").isNull())


def current_pipeline(rows: DataFrame, versions: list[Column], stored: str) -> DataFrame:
    """rows with is_current: whether their stored fingerprint is that of the versions, named in alphabetical order."""
    from ..functions.text import fingerprint

    return rows.withColumn("is_current", F.col(stored) == fingerprint(*versions))
