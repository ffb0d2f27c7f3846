"""Scores of matched rows: odd rows, by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayframe.operators import associations as a


def test_mapping_outcome_tells_absent_from_null(spark):
    rows = [(True, None, True, None, "correct"), (True, "x", True, None, "unsupported"), (True, None, True, "x", "incorrect"), (True, "x", True, "y", "incorrect"), (True, "x", True, "x", "correct"), (False, None, True, "x", "unevaluated"), (True, "x", False, None, "unevaluated")]
    df = spark.createDataFrame(rows, "eg boolean, e string, ag boolean, a string, want string")
    assert df.where(~a.mapping_outcome(*[F.col(c) for c in ("eg", "e", "ag", "a")]).eqNullSafe(F.col("want"))).count() == 0


def test_missing_values_contradict_nothing(spark):
    df = spark.createDataFrame([("1", None, "incorrect"), (None, "1", "incorrect"), ("1", "2", "incorrect"), ("1", "2", "unresolved")], "e string, p string, s string")
    assert [r[0] for r in df.select(a.contradicts([(F.col("e"), F.col("p"), F.col("s"))])).collect()] == [False, False, True, False]


def test_mapping_reasons_keep_each_label_once(spark):
    labels = spark.createDataFrame([("",), (None,), ("bad",), ("two",), ("one",), ("one",), ("none",)], "label string")
    aliases = spark.createDataFrame([("two", 1), ("two", 2), ("one", 3), ("one", 3), ("bad", 4)], "alias string, entry_id long")
    unsafe = spark.createDataFrame([("bad",), ("bad",)], "alias string")
    found = sorted((r.label or "", r.reason, r.entry_id or 0) for r in a.mapping_reasons(labels, aliases, unsafe).collect())
    assert found == [("", "empty-label", 0), ("", "empty-label", 0), ("bad", "unsafe-alias", 0), ("none", "no-exact-reviewed-alias", 0), ("one", "exact-reviewed-alias", 3), ("one", "exact-reviewed-alias", 3), ("two", "ambiguous-exact-alias", 0)]


def test_gate_with_skipped_rows_only_and_empty_table(spark):
    df = spark.createDataFrame([(1, "skip", True), (2, "resolve", False), (2, "skip", True), (3, None, True)], "k long, decision string, attention boolean")
    gate = a.confirmation_gate(df, ["k"], F.col("decision"), F.col("attention"))
    assert sorted((r.k, r.included, r.needs_review, r.can_confirm, r.blocked_reason) for r in gate.collect()) == [(1, 0, 0, False, "no-included-rows"), (2, 1, 0, True, None), (3, 1, 1, False, "rows-need-resolution")]
    assert a.confirmation_gate(df.limit(0), ["k"], F.col("decision"), F.col("attention")).count() == 0


def test_header_keys_and_qualitative_results(spark):
    from assayframe.functions import text

    rows = [("Größe1 – Hämo-B12", "grosse", "x not detected "), (None, None, None), ("", "  Non-Reactive ", "undetected")]
    df = spark.createDataFrame(rows, "h string, cell string, line string")
    found = [tuple(r) for r in df.select(text.header_key(F.col("h")), text.is_qualitative(F.col("cell")), text.qualitative_suffix(F.col("line"))).collect()]
    assert found == [("große 1 hamo b 12", False, "not detected"), (None, None, None), ("", True, None)]
