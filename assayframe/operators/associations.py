"""Scores of matched rows beyond single fields: associations, mappings, eligibility, sources, and what keeps a report from being confirmed.

Outcomes are expressions over one matched row, so every score is one aggregation with partial sums, whatever the size of a report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clamped, ratio

#: Why a label is mapped to a biomarker or not, in the order in which the cases are tried.
MAPPING_REASONS = ["empty-label", "unsafe-alias", "no-exact-reviewed-alias", "ambiguous-exact-alias", "exact-reviewed-alias"]


def association(statuses: list[Column]) -> Column:
    """correct where all fields are, unresolved where any is, else incorrect."""
    return F.when(F.forall(F.array(*statuses), lambda s: s == "correct"), "correct").when(F.array_contains(F.array(*statuses), "unresolved"), "unresolved").otherwise("incorrect")


def contradicts(fields: list[tuple[Column, Column, Column]]) -> Column:
    """Whether both sides give a value in some field (expected, actual, status) and these differ; a missing value is no contradiction."""
    found = F.lit(False)
    for expected, actual, status in fields:
        found = found | ((status == "incorrect") & expected.isNotNull() & actual.isNotNull())
    return found


def mapping_outcome(expected_given: Column, expected: Column, actual_given: Column, actual: Column) -> Column:
    """unevaluated, correct, incorrect or unsupported. A side may give no mapping at all, or say by a null that there is none."""
    return F.when(~(expected_given & actual_given), "unevaluated").when(expected.eqNullSafe(actual), "correct").when(actual.isNull(), "unsupported").otherwise("incorrect")


def eligibility_outcome(expected: Column, actual: Column) -> Column:
    return F.when(expected.isNull() | actual.isNull(), "unevaluated").when(expected == actual, "correct").otherwise("incorrect")


def outcome_counts(rows: DataFrame, keys: list[str], outcomes: dict[str, tuple[Column, list[str]]], **others: Column) -> DataFrame:
    """(keys, <name>_<outcome>..., others): how often each outcome of each name occurs; others are conditions, counted where they hold."""
    counts = [F.count(F.when(value == kind, 1)).alias(f"{name}_{kind}") for name, (value, kinds) in outcomes.items() for kind in kinds]
    return rows.groupBy(*keys).agg(*counts, *[F.count(F.when(c, 1)).alias(name) for name, c in others.items()])


def shortfall(whole: Column, part: Column) -> Column:
    """whole less part, never below zero."""
    return F.greatest(F.lit(0), whole - part)


def same_sources(expected: Column, actual: Column) -> Column:
    """Whether both list the same source ids in the same order; two nulls are the same."""
    return expected.eqNullSafe(actual)


def proposal_totals(rows: DataFrame, keys: list[str], sources: Column, fields: Column) -> DataFrame:
    """(keys, n, n_sources, n_fields, n_correct, source_accuracy, accuracy): proposals right in their sources, in their fields, and in both."""
    n = lambda c: F.count(F.when(c, 1))
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), n(sources).alias("n_sources"), n(fields).alias("n_fields"), n(sources & fields).alias("n_correct"))
    return sums.select("*", ratio(F.col("n_sources"), F.col("n")).alias("source_accuracy"), ratio(F.col("n_correct"), F.col("n")).alias("accuracy"))


def selection_accuracy(rows: DataFrame, keys: list[str], right: dict[str, Column]) -> DataFrame:
    """(keys, field, n_correct, n_expected, accuracy): one row for each field; the accuracy lies in 0 to 1."""
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n_expected"), *[F.count(F.when(c, 1)).alias(f) for f, c in right.items()])
    long = sums.unpivot([*keys, "n_expected"], list(right), "field", "n_correct")
    return long.select(*keys, "field", "n_correct", "n_expected", clamped(ratio(F.col("n_correct"), F.col("n_expected")), 0.0, 1.0).alias("accuracy"))


def support_split(rows: DataFrame, keys: list[str], supported: Column, mapped: Column, preserved: Column) -> DataFrame:
    """(keys, n_supported, n_mapped, n_unsupported, n_preserved, mapping_accuracy, preservation_accuracy): supported rows are to be mapped, others kept as they are."""
    n = lambda c: F.count(F.when(c, 1))
    sums = rows.groupBy(*keys).agg(n(supported).alias("n_supported"), n(supported & mapped).alias("n_mapped"), n(~supported).alias("n_unsupported"), n(~supported & preserved).alias("n_preserved"))
    part = lambda a, b: clamped(ratio(F.col(a), F.col(b)), 0.0, 1.0)
    return sums.select("*", part("n_mapped", "n_supported").alias("mapping_accuracy"), part("n_preserved", "n_unsupported").alias("preservation_accuracy"))


def mapping_reasons(labels: DataFrame, aliases: DataFrame, unsafe: DataFrame, label: str = "label") -> DataFrame:
    """labels with `n_entries`, `entry_id` (null unless exactly one entry has the alias) and `reason`.

    aliases (alias, entry_id), unsafe (alias): normalised like the labels. Aliases are summed up before the join, so a label stays one row. A null label is an empty one.
    """
    one = aliases.groupBy(F.col("alias").alias(label)).agg(F.count_distinct("entry_id").alias("_n"), F.min("entry_id").alias("_entry"))
    bad = unsafe.select(F.col("alias").alias(label), F.lit(True).alias("_unsafe")).distinct()
    found = labels.join(one, label, "left").join(bad, label, "left")
    n, text = F.coalesce("_n", F.lit(0)), F.coalesce(F.col(label), F.lit(""))
    reason = F.when(text == "", MAPPING_REASONS[0]).when(F.coalesce("_unsafe", F.lit(False)), MAPPING_REASONS[1]).when(n == 0, MAPPING_REASONS[2]).when(n > 1, MAPPING_REASONS[3]).otherwise(MAPPING_REASONS[4])
    return found.select(*[labels[c] if c != label else F.col(label) for c in labels.columns], n.alias("n_entries"), F.when(reason == MAPPING_REASONS[4], F.col("_entry")).alias("entry_id"), reason.alias("reason"))


def confirmation_gate(rows: DataFrame, keys: list[str], decision: Column, attention: Column) -> DataFrame:
    """(keys, included, needs_review, can_confirm, blocked_reason): skipped rows neither count nor block; at least one row must be left and none may need attention."""
    kept = ~decision.eqNullSafe(F.lit("skip"))
    sums = rows.groupBy(*keys).agg(F.count(F.when(kept, 1)).alias("included"), F.count(F.when(kept & attention, 1)).alias("needs_review"))
    blocked = F.when(F.col("needs_review") > 0, "rows-need-resolution").when(F.col("included") == 0, "no-included-rows")
    return sums.select("*", blocked.isNull().alias("can_confirm"), blocked.alias("blocked_reason"))
