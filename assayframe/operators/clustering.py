"""Clusters along one dimension: lines of a page, columns, runs, scopes.

Gaps alone are windows. Rules that compare with the state of the current cluster (its first member, its running mean) depend on the
order, so they are folds over sorted partitions, one group after the other; only the state of a group's clusters is held.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType

from .folds import folded


def gap_groups(df: DataFrame, keys: list[str], at: str, order: list[str], breaks: Column, name: str = "group") -> DataFrame:
    """df with the number, from 1, of its run: a row begins one where `breaks` holds; it may use the column _gap, the distance to the row before."""
    w = Window.partitionBy(*keys).orderBy(at, *order)
    gaps = df.withColumn("_gap", F.col(at) - F.lag(at).over(w)).withColumn("_break", F.coalesce(breaks, F.lit(False)).cast("long"))
    return gaps.withColumn(name, F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("_gap", "_break")


def _sized(df: DataFrame, keys: list[str], at: str, order: str, values: dict[str, Column], start: Callable, step: Callable, name: str, kind: DataType | None = None) -> DataFrame:
    """df with the fold's number; the fold sees the given values in the order of `at` and `order`."""
    named = df.withColumns({f"_{k}": v for k, v in values.items()})
    return folded(named, keys, [at, order], [f"_{k}" for k in values], start, step, name, kind).drop(*[f"_{k}" for k in values])


def _one_cluster() -> dict:
    return {"n": 0, "at": 0.0, "size": 0.0, "k": 0}


def _opened(state: dict, at: float, size: float = 0.0) -> int:
    state.update(n=state["n"] + 1, at=at, size=size, k=1)
    return state["n"]


def anchored_lines(df: DataFrame, keys: list[str], center: str, height: str, order: str, factor: float = 1.5, name: str = "line") -> DataFrame:
    """Lines whose first member is the anchor: a row joins if its centre is within factor * the greater height of it; the anchor never drifts."""

    def step(state: dict, at: float, size: float) -> int:
        return state["n"] if state["k"] and abs(at - state["at"]) <= factor * max(state["size"], size) else _opened(state, at, size)

    return _sized(df, keys, center, order, {"at": F.col(center).cast("double"), "size": F.col(height).cast("double")}, _one_cluster, step, name)


def running_mean_lines(df: DataFrame, keys: list[str], center: str, order: str, tolerance: float, name: str = "line") -> DataFrame:
    """Lines around the mean of their members so far; only the last line can take a row."""

    def step(state: dict, at: float) -> int:
        if not state["k"] or abs(at - state["at"]) > tolerance:
            return _opened(state, at)
        state.update(at=(state["at"] * state["k"] + at) / (state["k"] + 1), k=state["k"] + 1)
        return state["n"]

    return _sized(df, keys, center, order, {"at": F.col(center).cast("double")}, _one_cluster, step, name)


def mean_rows(df: DataFrame, keys: list[str], center: str, height: str, order: str, least: float = 1.25, factor: float = 0.35, name: str = "line") -> DataFrame:
    """Rows around the mean of their members: the first of all rows so far whose mean is within factor * height (least, if that is more) takes the next member."""

    def step(state: list, at: float, size: float) -> int:
        reach = max(least, size * factor)
        for n, (total, k) in enumerate(state):
            if abs(total / k - at) <= reach:
                state[n] = (total + at, k + 1)
                return n + 1
        state.append((at, 1))
        return len(state)

    return _sized(df, keys, center, order, {"at": F.col(center).cast("double"), "size": F.col(height).cast("double")}, list, step, name)


def _midpoint(tolerance: float) -> Callable:
    def step(state: dict, at: float) -> int:
        if not state["k"] or abs(at - state["at"]) > tolerance:
            return _opened(state, at)
        state["at"] = (state["at"] + at) / 2
        return state["n"]

    return step


def running_midpoint_anchors(df: DataFrame, keys: list[str], x: str, order: str, tolerance: float, name: str = "column") -> DataFrame:
    """Columns around an anchor that moves halfway to each new member."""
    return _sized(df, keys, x, order, {"at": F.col(x).cast("double")}, _one_cluster, _midpoint(tolerance), name)


def nearest_anchors(df: DataFrame, keys: list[str], x: str, order: str, tolerance: float, name: str = "column") -> DataFrame:
    """df with the column, from 0, whose anchor is nearest once all anchors have moved, the left one on a tie; a column of its first pass may so lose members."""
    step = _midpoint(tolerance)

    def place(state: dict, at: float) -> float:
        step(state, at)
        return state["at"]

    first = running_midpoint_anchors(df, keys, x, order, tolerance, "_n")
    placed = _sized(first, keys, x, order, {"at": F.col(x).cast("double")}, _one_cluster, place, "_anchor", DoubleType())
    ends = placed.groupBy(*keys, "_n").agg(F.max_by("_anchor", F.struct(x, order)).alias("_anchor"))
    anchors = ends.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_anchor"))), lambda e: e["_anchor"]).alias("_anchors"))
    nearest = F.array_min(F.transform("_anchors", lambda a, i: F.struct(F.abs(F.col(x) - a).alias("far"), i.alias("i"))))["i"]
    return df.join(anchors, keys).withColumn(name, nearest.cast("long")).drop("_anchors")


def scopes_by_gap(df: DataFrame, keys: list[str], at: str, order: list[str], factor: float = 6.0, name: str = "scope") -> DataFrame:
    """Scopes of a page: a gap of more than factor times the page's upper median gap begins a new one."""
    from .summaries import upper_median

    w = Window.partitionBy(*keys).orderBy(at, *order)
    gaps = df.withColumn("_g", F.col(at) - F.lag(at).over(w))
    medians = upper_median(gaps.where("_g is not null"), keys, "_g").withColumnRenamed("upper_median", "_m")
    return gap_groups(df.join(medians, keys, "left"), keys, at, order, F.col("_gap") > factor * F.col("_m"), name).drop("_m")


def packed_blocks(df: DataFrame, keys: list[str], order: str, size: str, limit: float, context: str, name: str = "block") -> DataFrame:
    """Blocks in document order of at most `limit` in total; a new context begins a block, and a row over the limit has block null.

    A row over the limit also ends the block before it.
    """

    def step(state: dict, weight: float, about: str | None) -> int | None:
        if weight > limit:
            state.update(open=False, context=about, size=weight)
            return None
        if state["open"] and about is not None and state["context"] == about and state["size"] + weight <= limit:
            state["size"] += weight
        else:
            state.update(n=state["n"] + 1, open=True, context=about, size=weight)
        return state["n"]

    start = lambda: {"n": 0, "open": False, "context": "", "size": 0.0}
    named = df.withColumns({"_size": F.col(size).cast("double"), "_context": F.col(context).cast("string")})
    return folded(named, keys, [order], ["_size", "_context"], start, step, name).drop("_size", "_context")


def reading_order(df: DataFrame, keys: list[str], line: str, x: str, text: str) -> DataFrame:
    """(keys, text): lines from top to bottom, each from left to right, joined by spaces and line breaks."""
    lines = df.groupBy(*keys, line).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(text).alias("t")))), lambda i: i["t"]), " ").alias("t"))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(line).alias("n"), F.col("t")))), lambda i: i["t"]), "\n").alias("text"))
