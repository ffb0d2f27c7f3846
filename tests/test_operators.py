"""Operators on small rows: the cases that the driver's tables don't have."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from assayframe import schemas
from assayframe.functions import dates, numbers, text
from assayframe.operators import catalogue, clustering, joins, layout, scoring, summaries, trends
from assayframe.sources import readers, sinks
from assayframe.streaming import events


def test_ldl_converts_exactly(spark):
    df = spark.createDataFrame([("ldl_c", 3.1, "mmol/L"), ("ldl_c", 100.0, "mg/dL"), ("mcv", 1.0, "g/L"), ("nope", 1.0, "fL")], "biomarker_id string, num double, unit string")
    got = {(r.biomarker_id, r.unit): r.normalized for r in trends.normalized(df, catalogue.biomarkers(spark), catalogue.unit_conversions(spark)).collect()}
    assert got == {("ldl_c", "mmol/L"): 119.877, ("ldl_c", "mg/dL"): 100.0, ("mcv", "g/L"): None, ("nope", "fL"): None}


def _reader(rows):
    """The history of one subject and biomarker, read in order with explicit state."""
    rows = sorted(rows, key=lambda r: (r["collection_date"] is None, r["collection_date"] or "", r["record_ordinal"], r["measurement_ordinal"] or 0))
    active, segment, open_, out = None, 0, False, {}
    for r in rows:
        ok = r["measurement_id"] is not None and r["collection_date"] and r["review_state"] == "confirmed" and r["kind"] == "numeric" and r["unit"] and r["specimen_ok"] and r["normalized"] is not None
        if ok and r["group_index"] is not None and active in (None, r["group_index"]):
            active = r["group_index"]
            if not open_:
                segment, open_ = segment + 1, True
            out[r["measurement_id"]] = segment
        else:
            open_ = False
    return out


def test_history_equals_a_sequential_reader(spark):
    rnd = random.Random(7)
    rows = []
    for subject in range(40):
        for rec in range(rnd.randint(1, 9)):
            date = None if rnd.random() < 0.15 else f"2024-0{rnd.randint(1, 5)}-01"
            if rnd.random() < 0.2:
                rows.append(dict(subject_id=subject, biomarker_id="b", record_id=rec, record_ordinal=rec, collection_date=date, measurement_id=None, measurement_ordinal=None, kind=None, review_state=None, unit=None, specimen_ok=None, group_index=None, normalized=None))
            for m in range(rnd.randint(0, 2)):
                kind = rnd.choice(["numeric"] * 5 + ["bounded"])
                rows.append(dict(subject_id=subject, biomarker_id="b", record_id=rec, record_ordinal=rec, collection_date=date, measurement_id=subject * 1000 + rec * 10 + m, measurement_ordinal=m, kind=kind, review_state=rnd.choice(["confirmed"] * 5 + ["needs-review"]), unit=rnd.choice(["mg/dL"] * 5 + [None]), specimen_ok=rnd.random() < 0.9, group_index=rnd.choice([0, 0, 1, None]), normalized=1.0))
    ddl = "subject_id int, biomarker_id string, record_id int, record_ordinal int, collection_date string, measurement_id int, measurement_ordinal int, kind string, review_state string, unit string, specimen_ok boolean, group_index int, normalized double"
    df = spark.createDataFrame([Row(**r) for r in rows], ddl).select("*", F.lit(True).alias("entry_known"), F.lit(True).alias("unit_known"), F.lit(True).alias("method_ok"), F.lit(False).alias("needs_profile"), F.lit(None).cast("string").alias("profile_id"))
    got: dict = {}
    for r in trends.points(trends.history(df)).collect():
        got.setdefault(r.subject_id, {})[r.measurement_id] = r.segment
    want = {s: _reader([r for r in rows if r["subject_id"] == s]) for s in range(40)}
    assert got == {s: w for s, w in want.items() if w}


def test_clusters_do_not_depend_on_order(spark):
    cells = [("r", 0, f"o{i}", f"t{i}", x, y, 0.1, 0.01) for i, (x, y) in enumerate([(0.1, 0.1), (0.4, 0.101), (0.1, 0.2), (0.41, 0.199)])]
    ddl = "report_id string, page_index int, observation_id string, text string, x double, y double, width double, height double"
    seen = {tuple(sorted((r.observation_id, r.line, r.column) for r in layout.lattice(spark.createDataFrame(list(p), ddl)).collect())) for p in itertools.islice(itertools.permutations(cells), 0, 24, 5)}
    assert len(seen) == 1
    assert {(o, line, col) for o, line, col in next(iter(seen))} == {("o0", 1, 1), ("o1", 1, 2), ("o2", 2, 1), ("o3", 2, 2)}


def test_packed_blocks(spark):
    df = spark.createDataFrame([(1, i, s, c) for i, (s, c) in enumerate([(4, "a"), (4, "a"), (4, "a"), (20, "a"), (1, "a"), (1, "b")])], "p int, i int, size int, c string")
    got = [r.block for r in clustering.packed_blocks(df, ["p"], "i", "size", 10, "c").orderBy("i").collect()]
    assert got == [1, 1, 2, None, 3, 4]


def test_upper_median_takes_the_upper_of_two(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)] + [("b", 5.0), ("c", None)], "k string, v double")
    assert {r.k: r.upper_median for r in summaries.upper_median(df, ["k"], "v").collect()} == {"a": 3.0, "b": 5.0}


def test_nearest_by_position_prefers_the_earlier_on_a_tie(spark):
    rows = spark.createDataFrame([("p", 1, 5.0), ("p", 2, 0.0), ("q", 3, 1.0)], "k string, row_id int, at double")
    contexts = spark.createDataFrame([("p", 10, 4.0), ("p", 11, 6.0)], "k string, c int, at double")
    assert {r.row_id: r.c for r in joins.nearest_by_position(rows, contexts, ["k"], "at", "c").collect()} == {1: 10, 2: 10, 3: None}


def test_match_cascade_prefers_date_and_never_matches_by_value_alone(spark):
    ddl = "report_id string, idx long, label string, page int, value double, date string, specimen string, unit string"
    e = spark.createDataFrame([("r", 0, "glucose", 1, 5.0, "2024-01-01", "serum", "mg/dL"), ("r", 1, "iron", 1, 7.0, None, None, None)], ddl)
    p = spark.createDataFrame([("r", 0, "glucose", 1, 5.0, None, "serum", "mg/dL"), ("r", 1, "glucose", 1, 5.0, "2024-01-01", None, None), ("r", 2, "zinc", 1, 7.0, None, None, None)], ddl)
    assert [tuple(r) for r in scoring.match_cascade(e, p).collect()] == [("r", 0, 1, 1)]


def test_schema_is_checked(spark):
    df = spark.createDataFrame([], schemas.TABLES["alias"])
    assert schemas.check_schema(df, "alias").columns == ["biomarker_id", "alias", "alias_norm"]
    with pytest.raises(ValueError, match="unknown"):
        schemas.check_schema(df.withColumn("more", F.lit(1)), "alias")


def test_nulls_and_odd_text(spark):
    df = spark.createDataFrame([(None,), ("",), ("=1+1",), ("Ｆｉｎｅ ½ Ärzte",)], "x string")
    r = df.select(numbers.locale_decimal(F.col("x")).alias("n"), dates.lab_date(F.col("x"), F.lit("en-US")).alias("d"), text.csv_cell(F.col("x")).alias("c"), text.alias_key_exact(F.col("x")).alias("a")).collect()
    assert [x.n for x in r] == [None] * 4 and [x.d for x in r] == [None] * 4
    assert [x.c for x in r[:3]] == ["NULL", '""', '"\'=1+1"']
    assert [x.a for x in r] == [None, "", "1 1", "fine 1 2 arzte"]


def test_json_that_does_not_fit_is_set_aside(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1, "b": "x"}\nnot json\n{"a": "no number"}\n{"a": 2}\n')
    good, bad = readers.json_rows(spark, str(tmp_path / "a.json"), "a int, b string")
    assert sorted(tuple(r) for r in good.collect()) == [(1, "x"), (2, None)] and bad.count() == 2


def test_word_boxes(spark, tmp_path):
    (tmp_path / "p.xml").write_text('<doc><page width="10" height="20"><word xMin="1" yMin="2" xMax="3" yMax="4">LDL</word><word xMin="5" yMin="2" xMax="6" yMax="4">3.1</word></page></doc>')
    assert [tuple(r)[1:] for r in readers.word_boxes(spark, str(tmp_path / "p.xml")).collect()] == [(1.0, 2.0, 3.0, 4.0, "LDL"), (5.0, 2.0, 6.0, 4.0, "3.1")]


def test_manifest_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, "=x" if i % 2 else None) for i in range(50)], "b int, a string")
    one, many = (sinks.manifest({"t": sinks.json_lines(df.repartition(n))}).first() for n in (1, 7))
    assert one == many and one.n_rows == 50
    assert sinks.csv_lines(df.where("b < 2")).orderBy("value").collect()[1].value == '"1","\'=x"'


def test_streams_count_an_event_once(spark, tmp_path):
    rows = [(1, "2024-01-01 10:00:00", "a"), (1, "2024-01-01 10:00:00", "a"), (2, "2024-01-02 09:00:00", "b")]
    spark.createDataFrame(rows, "id int, at string, kind string").withColumn("at", F.to_timestamp("at")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, at timestamp, kind string").parquet(str(tmp_path / "in"))
    seen = []
    q = events.changes(events.once(stream, "id", "at"), lambda df, n: seen.extend(r.id for r in df.collect()), str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(seen) == [1, 2]
    q = events.daily_counts(stream, "at", ["kind"]).writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(str(r.day), r.kind, r.n) for r in spark.table("daily").collect()} == {("2024-01-01", "a", 2), ("2024-01-02", "b", 1)}


def _plain_cascade(expected, produced):
    """The passes over whole lists, as a reader of one report at a time goes."""
    free, wanted, out = list(range(len(produced))), list(range(len(expected))), set()
    keys = [lambda r: (r[1], r[2], r[3]), lambda r: (r[1], r[2]), lambda r: r[4] and (r[1], r[4]), lambda r: (r[1],)]
    for n, key in enumerate(keys):
        for e in list(wanted):
            x = expected[e]
            near = [p for p in free if key(x) is not None and produced[p][0] == x[0] and key(produced[p]) == key(x)]
            if near:
                score = lambda p: 100 * (x[4] is not None and produced[p][4] == x[4]) + 10 * (x[5] is not None and produced[p][5] == x[5]) + 5 * (produced[p][2] == x[2]) + 2 * (x[6] is not None and produced[p][6] == x[6])  # noqa: B023, E731
                best = max(near, key=lambda p: (score(p), -p))
                out.add((x[0], e, best, n + 1))
                free.remove(best)
                wanted.remove(e)
    return out


def test_match_cascade_equals_plain_passes(spark):
    rnd = random.Random(12)
    row = lambda: (rnd.choice("rs"), rnd.choice(["iron", "lead"]), rnd.choice([None, 1, 2]), rnd.choice("123"), rnd.choice([None, "2024-01-01", "2024-02-01"]), rnd.choice([None, "serum"]), rnd.choice([None, "g/L", "mg/dL"]))
    e, p = [row() for _ in range(60)], [row() for _ in range(70)]
    ddl = "report_id string, label string, page int, value string, date string, specimen string, unit string, idx long"
    df = lambda rows: spark.createDataFrame([(*r[:1], f" {r[1].upper() if i % 2 else r[1]} ", *r[2:], i) for i, r in enumerate(rows)], ddl)
    assert {tuple(r) for r in scoring.match_cascade(df(e), df(p)).collect()} == _plain_cascade(e, p)


def test_numbered_queries_are_told_from_others():
    import bench

    assert bench.numbered(["open_drafts", "op10_a", "op2_b", "op_c", "operators"]) == ["op2_b", "op10_a"]
