"""Observations that cover one or two bands of a page: their spans are checked and dealt into bands, or the observation is set aside with a reason.

Observations: page keys, observation_id, parent_id (null: the same), text, x, y, width, height, spans array<struct<start, end, text, parent_id, x, y, width, height>> (null: none were
read, places null: in proportion to the text), independent (each span stands for itself), table_id, row_index, column_index, is_cell (claims to be a table's cell).
Places count characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import between
from .folds import folded

#: An observation with more bands than this, or two of which less than GAP typical heights are between, is not taken apart.
MOST_BANDS, GAP = 2, 0.2
REASONS = ["invalid-table-identity", "invalid-token-span", "too-many-y-bands", "contradictory-y-bands"]


def same_band(a: tuple, b: tuple, height: float) -> bool:
    """Of boxes (top, bottom): whether a fifth of the lower one overlaps, or the centres are near for that typical height."""
    overlap = max(0.0, min(a[1], b[1]) - max(a[0], b[0]))
    return overlap / max(1e-6, min(a[1] - a[0], b[1] - b[0])) >= 0.2 or abs(sum(a) / 2 - sum(b) / 2) <= height * 0.7


def _start() -> dict:
    return {"bands": [], "loose": 0, "first": []}


def _deal(state: dict, top: float, bottom: float, height: float, own_top: float, own_bottom: float) -> int:
    """The span's band plus one, zero if two fit, in units of 4096; below that how many bands there are if the first that fits is taken."""
    box, bands, first = (top, bottom), state["bands"], state["first"]
    fits = [i for i, b in enumerate(bands) if same_band(b, box, height)]
    if len(fits) == 1:
        bands[fits[0]] = (min(bands[fits[0]][0], top), max(bands[fits[0]][1], bottom))
    elif not fits:
        bands.append(box)
    own = (own_top, own_bottom)
    at = next((i for i, b in enumerate(first) if same_band(b, own, height)), None)
    if at is None:
        first.append(own)
    else:
        first[at] = (min(first[at][0], own_top), max(first[at][1], own_bottom))
    place = 0 if len(fits) > 1 else (fits[0] if fits else len(bands) - 1) + 1
    return place * 4096 + len(first)


def _checked(text: Column, parent: Column) -> Column:
    """Whether the sorted spans are places of the text one after the other, with the text they claim, of this parent, with real boxes."""
    box = lambda s: s["width"].isNull() | ((s["width"] > 0) & (s["height"] > 0) & ~F.isnan(s["x"] + s["y"] + s["width"] + s["height"]))

    def good(s: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get("_spans", i - 1)["end"]).otherwise(F.lit(0))
        inside = (s["start"] >= 0) & (s["end"] <= F.length(text)) & (s["start"] < s["end"]) & (s["start"] >= before)
        return F.coalesce(inside, F.lit(False)) & (s["parent_id"].isNull() | (s["parent_id"] == parent)) & (s["text"].isNull() | (s["text"] == between(text, s["start"], s["end"]))) & F.coalesce(box(s), F.lit(False))

    return (F.size("_spans") > 0) & F.forall(F.transform("_spans", good), lambda g: g)


def expanded(observations: DataFrame, page: list[str]) -> tuple[DataFrame, DataFrame]:
    """(bands, unresolved). bands: (page, observation_id, parent_id, band, cells, x, y, width, height, row_index, column_index), band counts from 0 downwards; cells array<struct<start, end,
    id, text, x, y, width, height>> in the order of the text. unresolved: (page, observation_id, parent_id, reason).

    An observation without spans is one cell and band. One that claims to be a cell of a table without saying which is set aside, as is one with faulty
    spans, with more than two bands, or with bands that run into each other. Rows with the same page and observation_id are one observation with all their spans.
    """
    o = observations.withColumn("parent_id", F.coalesce("parent_id", "observation_id")).withColumn("_spans", F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["parent_id"].alias("parent_id"), *[s[c].cast("double").alias(c) for c in ("x", "y", "width", "height")]))))
    in_table = F.coalesce(F.col("is_cell") & (F.length("table_id") > 0) & (F.col("row_index") >= 0) & (F.col("column_index") >= 0), F.lit(False))
    reason = F.when(F.coalesce(F.col("is_cell"), F.lit(False)) & ~in_table, REASONS[0]).when(F.col("spans").isNotNull() & ~F.coalesce(_checked(F.col("text"), F.col("parent_id")), F.lit(False)), REASONS[1])
    o = o.withColumn("_reason", reason).withColumn("_in_table", in_table)
    keys = [*page, "observation_id"]
    about = ["parent_id", "row_index", "column_index"]
    seeded = [F.when(F.col("_in_table"), F.col(c)).alias(c) for c in ("row_index", "column_index")]
    length = F.length("text")

    def cell(s: Column) -> Column:
        start, end = s["start"] / length, s["end"] / length
        box = [F.coalesce(s["x"], F.col("x") + F.col("width") * start), F.coalesce(s["y"], F.col("y")), F.coalesce(s["width"], F.greatest(F.lit(1e-6), F.col("width") * (end - start))), F.coalesce(s["height"], F.col("height"))]
        name = F.concat_ws(":", "parent_id", s["start"].cast("string"), s["end"].cast("string"))
        own = [F.coalesce(s["y"], F.col("y")), F.coalesce(s["height"], F.col("height"))]
        return F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), name.alias("id"), between(F.col("text"), s["start"], s["end"]).alias("text"), *[b.cast("double").alias(n) for b, n in zip(box, ("x", "y", "width", "height"), strict=True)]), *own

    fine = o.where("_reason IS NULL")
    whole = fine.where("spans IS NULL").select(*keys, "parent_id", F.lit(0).cast("long").alias("band"), F.array(F.struct(F.lit(0).alias("start"), length.alias("end"), F.col("observation_id").alias("id"), "text", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")])).alias("cells"), *seeded)
    listed = fine.where("spans IS NOT NULL").withColumn("_i", F.explode(F.sequence(F.lit(0), F.size("_spans") - 1))).withColumn("_s", F.get("_spans", F.col("_i")))
    made, own_y, own_h = cell(F.col("_s"))
    heights = F.sort_array(F.transform("_spans", lambda s: F.coalesce(s["height"], F.col("height").cast("double"))))
    middle = F.get(heights, F.floor(F.size(heights) / 2).cast("int"))
    parts = listed.select(*keys, "parent_id", *seeded, F.coalesce("independent", F.lit(False)).alias("independent"), "_i", made.alias("cell"), middle.alias("height"), own_y.cast("double").alias("own_top"), (own_y + own_h).cast("double").alias("own_bottom"))
    parts = parts.withColumn("top", F.col("cell.y")).withColumn("bottom", F.col("cell.y") + F.col("cell.height"))
    single = parts.where("independent").select(*keys, "parent_id", F.lit(0).cast("long").alias("band"), F.array("cell").alias("cells"), "row_index", "column_index")
    dealt = folded(parts.where("NOT independent"), keys, ["_i"], ["top", "bottom", "height", "own_top", "own_bottom"], _start, _deal, "dealt")
    dealt = dealt.withColumn("place", F.floor(F.col("dealt") / 4096)).withColumn("n_loose", F.col("dealt") % 4096)
    groups = dealt.groupBy(*keys, *about, "place").agg(F.sort_array(F.collect_list("cell")).alias("cells"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.min("cell.x").alias("x"), F.max("height").alias("height"), F.max("n_loose").alias("n_loose"))
    one = groups.groupBy(*keys, *about).agg(F.sort_array(F.collect_list(F.struct("top", "x", "bottom", "cells"))).alias("g"), F.min("place").alias("least"), F.max("height").alias("height"), F.max("n_loose").alias("n_loose"))
    first, second = F.get("g", F.lit(0)), F.get("g", F.lit(1))
    apart = F.greatest(first["top"], second["top"]) - F.least(first["bottom"], second["bottom"])
    unclear = (F.col("least") == 0) | (F.size("g") > MOST_BANDS) | ((F.size("g") == 2) & (apart < F.col("height") * GAP))
    one = one.withColumn("reason", F.when(unclear, F.when(F.col("n_loose") > MOST_BANDS, REASONS[2]).otherwise(REASONS[3])))
    banded = one.where("reason IS NULL").select(*keys, *about, F.posexplode("g").alias("band", "b")).select(*keys, "parent_id", F.col("band").cast("long").alias("band"), F.col("b.cells").alias("cells"), "row_index", "column_index")
    every = whole.unionByName(single).unionByName(banded)
    low = lambda c: F.array_min(F.transform("cells", lambda x: x[c]))
    high = lambda c, size: F.array_max(F.transform("cells", lambda x: x[c] + x[size]))
    boxed = every.select(*keys, "parent_id", "band", "cells", low("x").alias("x"), low("y").alias("y"), (high("x", "width") - low("x")).alias("width"), (high("y", "height") - low("y")).alias("height"), "row_index", "column_index")
    faulty = o.where("_reason IS NOT NULL").select(*keys, "parent_id", F.col("_reason").alias("reason"))
    return boxed, faulty.unionByName(one.where("reason IS NOT NULL").select(*keys, "parent_id", "reason"))


def _final() -> dict:
    return {"bands": [], "unclear": None}


def _count(state: dict, top: float, bottom: float, height: float) -> int:
    """How many bands there are after this box; if two fit it, at least two and no more are looked for."""
    if state["unclear"] is not None:
        return state["unclear"]
    box, bands = (top, bottom), state["bands"]
    fits = [i for i, b in enumerate(bands) if same_band(b, box, height)]
    if len(fits) > 1:
        state["unclear"] = max(2, len(bands))
        return state["unclear"]
    if fits:
        bands[fits[0]] = (min(bands[fits[0]][0], top), max(bands[fits[0]][1], bottom))
    else:
        bands.append(box)
    return len(bands)


def count_bands(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_bands): in how many bands the cells (x, y, width, height) of a row lie. Cells over 1.8 typical heights don't count, unless there are no others."""
    heights = cells.groupBy(*keys).agg(F.sort_array(F.collect_list("height")).alias("_h")).withColumn("_typical", F.get("_h", F.floor(F.size("_h") / 2).cast("int"))).select(*keys, "_typical")
    usual = cells.join(heights, keys).where(F.col("height") <= F.col("_typical") * 1.8).select(*keys, F.col("y").cast("double").alias("top"), (F.col("y") + F.col("height")).cast("double").alias("bottom"), F.col("x").cast("double").alias("x"), F.col("_typical").cast("double").alias("height"), F.col("height").cast("double").alias("_own"), F.col("width").cast("double").alias("_w"))
    counted = folded(usual, keys, ["top", "x", "_own", "_w"], ["top", "bottom", "height"], _final, _count, "n")
    return counted.groupBy(*keys).agg(F.max("n").alias("n_bands"))
