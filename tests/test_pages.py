"""Decisions about pages: odd answers, corridors, and centres against a plain reader."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from assayframe.operators import pages

GOOD = '{"rows":[{"flag":null,"label":" a ","value":"1","unit":"","reference_interval":null}]}'


@pytest.mark.parametrize(
    ("raw", "error"),
    [
        (GOOD, None), ('{"rows":[]}', None), (None, "malformed-json"), ("", "malformed-json"), ("null", "malformed-envelope"), ("[]", "malformed-envelope"), ("7", "malformed-envelope"),
        ('{"rows":{}}', "malformed-envelope"), ('{"rows":null}', "malformed-envelope"), ('{"rows":[1]}', "row-0-malformed"), ('{"rows":[null]}', "row-0-malformed"), ('{"rows":[],"rows":[]}', "malformed-json"),
        (GOOD.replace(" a ", "  "), "row-0-malformed"), (GOOD.replace('"1"', "true"), "row-0-malformed"), (GOOD.replace('"1"', '"' + "x" * 512 + '"'), None), (GOOD.replace('"1"', '"' + "x" * 513 + '"'), "row-0-malformed"),
        (GOOD.replace('"1"', '["1"]'), "row-0-malformed"), (GOOD.replace('"flag":null', '"flag":null,"more":null'), "row-0-malformed"),
    ],
)
def test_answers_count_as_a_whole(spark, raw, error):
    got = pages.decoded_answers(spark.createDataFrame([(raw, "kept")], "raw string, other string"), "raw").first()
    assert (got.error, got.other, got.rows is None) == (error, "kept", error is not None)


def test_fields_are_trimmed_and_blank_ones_null(spark):
    rows = pages.decoded_answers(spark.createDataFrame([(GOOD,)], "raw string"), "raw").first().rows
    assert [r.asDict() for r in rows] == [{"label": "a", "value": "1", "unit": None, "reference_interval": None, "flag": None}]


def test_centers_like_a_plain_reader(spark):
    rng = random.Random(5)
    cells = [(page, float(rng.randrange(60))) for page in range(40) for _ in range(rng.randrange(1, 15))]
    want = set()
    for page in {p for p, _ in cells}:
        runs: list[list[float]] = []
        for x in sorted(x for p, x in cells if p == page):
            if runs and abs(x - statistics.median(runs[-1])) <= 2:
                runs[-1].append(x)
            else:
                runs.append([x])
        want |= {(page, statistics.median(r)) for r in runs}
    got = pages.column_centers(spark.createDataFrame(cells, "page int, x double"), ["page"], "x", 2)
    assert {tuple(r) for r in got.collect()} == want
    assert pages.column_centers(got.where("false").withColumnRenamed("center", "x"), ["page"], "x", 2).count() == 0


def test_corridors_end_at_gaps_and_unclear_headers(spark):
    # (page, row, top, bottom, kind, in_table) and the header that owns the row
    rows = [
        (1, 1, 0, 1, "absent", False, None), (1, 2, 1, 2, "column", False, None), (1, 3, 2, 3, "absent", False, 2), (1, 4, 3, 4, "column", False, 2), (1, 5, 9, 10, "absent", False, None), (1, 6, 10, 11, "absent", False, None),
        (2, 1, 0, 1, "column", True, None), (2, 2, 9, 10, "absent", True, 1), (2, 3, 10, 11, "ambiguous", True, 1), (2, 4, 11, 12, "absent", True, None),
    ]
    df = spark.createDataFrame(rows, "page int, id int, top int, bottom int, kind string, in_table boolean, want int")
    owned = pages.owned_in_corridor(df, ["page"], ["top", "id"], top="top", bottom="bottom", row_id="id", header_kind="kind", in_table=F.col("in_table"), most_gap=3)
    assert owned.where("not (header_id <=> want)").count() == 0 and owned.count() == len(rows)


def test_no_route_without_words_or_origin(spark):
    df = spark.createDataFrame([(0, None, None), (1, " \n", None), (1, None, "a"), (1, "t", None), (1, "t", "b"), (1, "t", "a")], "n int, text string, origin string")
    got = [r[0] for r in df.select(pages.route_reason(F.col("n"), F.col("text"), {"origin": (F.col("origin"), "a")})).collect()]
    assert got == ["empty-observations", "empty-source-text", "mixed-or-unknown-provenance", "mixed-or-unknown-provenance", "no-selectable-text-provenance", "bound-selectable-text-source"]


def test_measurements_have_a_value_a_label_and_unit_or_reference(spark):
    rows = [("a", "1", "g/L", None, 1), ("b", "<2", None, "1-3", 1), (None, "1", "g/L", None, 1), ("c", "1", None, None, 1), ("d", None, "g/L", None, 0), ("e", None, "g/L", "1-3", 2), ("a", "1", "g/L", None, 1)]
    df = spark.createDataFrame(rows, "label string, value string, unit string, reference string, n_values int")
    got = sorted((r.label, r.value_type) for r in pages.associated(df).collect())
    assert got == [("a", "numeric"), ("a", "numeric"), ("b", "bounded")] and pages.associated(df.where("false")).count() == 0
