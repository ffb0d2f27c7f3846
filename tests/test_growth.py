"""What a query does for one row must not be repeated, and what it keeps must not grow with pairs."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from assayframe.functions import dates, numbers
from assayframe.operators import header_tables, joins, pages, proposals, source_rows


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_answers_rows_are_read_once(spark):
    """Each row of an answer was turned into a map for each mention of a field."""
    item = '{"label":" a ","value":"1","unit":null,"reference_interval":" ","flag":"H"}'
    answers = [f'{{"rows":[{item}]}}', f'{{"rows":[{item.replace("null", "2")}]}}', f'{{"rows":[{item}]}}}},{{"x":2', "null", None]
    found = pages.decoded_answers(spark.createDataFrame(list(enumerate(answers)), "id int, raw string"), "raw")
    assert len(re.findall(r"variant_get\(", optimized(found.where("error is null").select("id", F.get("rows", F.lit(0))["label"])))) <= 6
    assert {r["id"]: r["error"] for r in found.collect()} == {0: None, 1: "row-0-malformed", 2: "malformed-json", 3: "malformed-envelope", 4: "malformed-json"}


def test_counts_of_pages_read_cells_once(spark):
    """The observations were read by each of three branches, and dates and specimens for counts."""
    kind = "report_id string, page_index int, ordinal long, observation_id string, text string, x double, y double, width double, height double, table_id string, row_index int, column_index int, spans array<struct<id:string,text:string,x:double,y:double,width:double,height:double>>"
    texts = [["Test", "Result", "Current result", "Units"], ["Na", "", "140", "mmol/L"], ["K", "", "4,1 H", "mmol/L"], ["Test", "", "", ""]]
    rows = [("r", 0, 10 * i + j, f"o{i}{j}", t, 0.2 * j, 0.1 * i, 0.1, 0.02, None, None, None, None) for i, row in enumerate(texts) for j, t in enumerate(row) if t]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    found = header_tables.page_counts(spark.createDataFrame(rows, kind).mapInArrow(counted, kind)).collect()
    assert [(r["n_rows"], r["n_headers"], r["n_candidates"], r["n_measurements"]) for r in found] == [(4, 1, 3, 2)]
    assert read.value == len(rows)


def test_a_text_is_matched_once_for_its_date_and_number(spark):
    df = spark.createDataFrame([("1/2/2024",), ("31-01-2024",), ("2024-02-30",), ("<= 5,5",), ("≥7",), ("abc",), ("Abc ",), ("",), (None,)], "t string")
    found = df.select(dates.header_date(F.col("t"), F.lit("de-DE")).cast("string").alias("d"), numbers.scalar_value(F.col("t"), F.lit("ABC")).alias("v"))
    assert optimized(found).count("regexp_extract") <= 8
    assert [(r["d"], r["v"] and tuple(r["v"])) for r in found.collect()] == [
        ("2024-02-01", ("text", None, None, "1/2/2024")), ("2024-01-31", ("text", None, None, "31-01-2024")), (None, ("text", None, None, "2024-02-30")), (None, ("bounded", "<=", 5.5, None)), (None, ("bounded", ">=", 7.0, None)),
        (None, ("categorical", None, None, "abc")), (None, ("categorical", None, None, "Abc")), (None, None), (None, None),
    ]


def test_choices_meet_near_options_only(spark):
    """All pairs of equal keys were formed and ranked. Options at equal distances, on both sides, far away, none of a kind, competing owners and unknown distances."""
    part = spark.range(400).selectExpr("id AS p", "id % 2 AS k", "id % 13 AS size", "CASE WHEN id % 97 > 0 THEN (id * 37 % 1000) / 4.0 END AS x")
    option = spark.range(600).selectExpr("id AS s", "id % 2 AS k", "id % 6 AS kind", "id % 11 AS y", "id * 0.75 AS c")
    rank, owner = F.floor(F.abs(F.col("size") - F.col("kind")) / 3), F.when((F.col("p") + F.col("kind")) % 4 == 0, True).when((F.col("p") + F.col("kind")) % 2 == 0, False)
    dy = F.abs(F.col("size") - F.col("y"))
    pairs = part.join(option, "k").withColumns({"rank": rank, "owner": owner, "dx": F.abs(F.col("x") - F.col("c")) / 10, "dy": dy})
    near = joins.near_candidates(part, option, ["k"], "p", ["kind"], rank, owner, "x", "c", 10, 0.25, "dx").withColumn("dy", dy)
    assert near.count() < 400 * 4 < pairs.count() / 50
    chosen = lambda c: sorted(map(tuple, joins.cascading_choice(c, ["p"], "rank", "owner", [("dx", 0.25), ("dy", 1.0)], "s").collect()))
    assert chosen(near) == chosen(pairs)


def test_ids_of_equal_sets_are_dealt_into_tiles(spark):
    """All ids of a set came to one task of a join of pairs."""
    sets = spark.range(300).selectExpr("1 AS k", "id", "CASE id % 5 WHEN 0 THEN sequence(1, 10) WHEN 1 THEN sequence(2, 10) WHEN 2 THEN sequence(1, 9) WHEN 3 THEN sequence(1, 7) ELSE array(1, 1, 2) END AS items")
    found = joins.set_similarity(sets, ["k"], "id", "items", 0.9, 7, digits=3, chunk=7)
    like = {(0, 0): 1.0, (1, 1): 1.0, (2, 2): 1.0, (3, 3): 1.0, (0, 1): 0.9, (0, 2): 0.9}
    want = sorted((1, a, b, like[key]) for a in range(300) for b in range(a + 1, 300) if (key := tuple(sorted((a % 5, b % 5)))) in like)
    assert sorted(map(tuple, found.collect())) == want
    assert "idsa" in optimized(found)


def test_texts_that_repeat_are_read_once(spark):
    """Every row went through the matches of numbers, ranges, units and aliases by itself."""
    texts = ["Na 140 mmol/L", "K 4,1 mmol/L 3.5 - 5.1", "", None, "LDL <5 mmol/L"]
    rows = spark.range(500).select("id", F.get(F.array(*[F.lit(t) for t in texts]), (F.col("id") % 5).cast("int")).alias("text")).repartition(4)
    aliases = spark.createDataFrame([("na", "Na"), ("k", "K")], "entry_id string, alias string")
    for found in (source_rows.read_rows(rows, "text", repeated=True), source_rows.read_rows(rows, "text", aliases)):
        assert found.columns[:2] == ["id", "text"] and "Aggregate" in optimized(source_rows.read_rows(rows, "text", repeated=True))
        alone = source_rows.read_rows(rows.where("id < 5"), "text", aliases if found.where("entry_id IS NOT NULL").count() else None)
        one = {r["text"]: tuple(r)[1:] for r in alone.collect()}
        got = found.collect()
        assert len(got) == 500 and all(tuple(r)[1:] == one[r["text"]] for r in got)


def test_labels_alike_are_decided_once(spark):
    """Labels had to have a key, and each was cut for itself; rows alike in all but one null field differ."""
    aliases = spark.createDataFrame([("na", "Na")], "entry_id string, alias string")
    kinds = [("Na 140", "140", None, None, None), ("Na 140", "141", None, None, None), ("Na 140", None, None, "140", None), ("Na H", "1", None, None, "H"), ("Na H", "1", None, None, None), (" Na ", None, None, None, None), (None, "1", None, None, None)]
    labels = spark.createDataFrame([(i, *k) for i in range(30) for k in kinds], "id int, label string, value string, unit string, reference string, flag string")
    found = source_rows.display_labels(labels, aliases)
    assert len(found.collect()) == 210
    shown = {(r["label"], r["value"], r["reference"], r["flag"]): r["display"] for r in found.collect()}
    assert [shown[(k[0], k[1], k[3], k[4])] for k in kinds] == ["Na", "Na 140", "Na", "Na", "Na H", "Na", None]


def test_answers_alike_are_read_once(spark):
    """Each batch's answer was parsed for itself; batches that share one, and a null, keep their own rows."""
    raw = '[{"rowKey":"r0","labelKey":"c0","valueKey":"c1","unitKey":null,"referenceIntervalKey":null,"flagKey":null,"role":"preserve"}]'
    batches = spark.createDataFrame([(i, None if i == 7 else "[" if i == 8 else raw) for i in range(9)], "batch_id long, raw string")
    rows = spark.createDataFrame([(i, 0, f"row-{i}", [f"{i}a", f"{i}b"]) for i in range(9)], "batch_id long, position int, row_id string, ids array<string>")
    found = proposals.valid_proposals(batches, rows, spark.createDataFrame([("x",)], "biomarker_id string"))
    assert sorted((r["batch_id"], r["row_id"], r["label"], r["value"]) for r in found.collect()) == [(i, f"row-{i}", f"{i}a", f"{i}b") for i in range(7)]
    assert "parse_json" not in optimized(found)
