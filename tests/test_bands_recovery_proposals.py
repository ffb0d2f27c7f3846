"""Bands of observations, rows of broken answers and proposals against plain readers, fault by fault."""

from __future__ import annotations

import json
import random

import pytest

from assayframe.operators import bands, proposals, recovery

SPAN = "struct<start:int,end:int,text:string,parent_id:string,x:double,y:double,width:double,height:double>"
OBS = f"page int, observation_id string, parent_id string, text string, x double, y double, width double, height double, spans array<{SPAN}>, independent boolean, is_cell boolean, table_id string, row_index int, column_index int"


def plain_bands(spans: list[tuple]) -> list[list[tuple]] | None:
    heights = sorted(s[7] for s in spans)
    h = heights[len(heights) // 2]
    groups: list[list] = []
    for s in sorted(spans, key=lambda s: s[:2]):
        box = (s[5], s[5] + s[7])
        fits = [g for g in groups if bands.same_band((min(x[5] for x in g), max(x[5] + x[7] for x in g)), box, h)]
        if len(fits) > 1:
            return None
        if fits:
            fits[0].append(s)
        else:
            groups.append([s])
    if len(groups) > 2:
        return None
    groups.sort(key=lambda g: (min(x[5] for x in g), min(x[4] for x in g)))
    if len(groups) == 2 and groups[1][0] and max(min(x[5] for x in g) for g in groups) - min(max(x[5] + x[7] for x in g) for g in groups) < h * 0.2:
        return None
    return groups


def test_bands_like_a_plain_reader_in_any_order(spark):
    rnd = random.Random(2)
    rows, want = [], {}
    for i in range(300):
        n = rnd.randint(1, 6)
        spans = [(4 * k, 4 * k + 3, None, None, k / 10, rnd.choice([0.1, 0.105, 0.125, 0.13, 0.2]), 0.05, rnd.choice([0.02, 0.02, 0.03])) for k in range(n)]
        found = plain_bands(spans)
        want[str(i)] = found and [[s[0] for s in g] for g in found]
        rnd.shuffle(spans)
        rows.append((0, str(i), None, "abc " * n, 0.0, 0.1, 1.0, 0.02, spans, False, False, None, None, None))
    got, unresolved = bands.expanded(spark.createDataFrame(rows, OBS), ["page"])
    seen = {str(i): None for i in range(300)}
    for r in sorted(got.collect(), key=lambda r: r.band):
        seen[r.observation_id] = (seen[r.observation_id] or []) + [[c.start for c in r.cells]]
        assert all(c.text == "abc" for c in r.cells)
    assert seen == want and {r.observation_id for r in unresolved.collect()} == {k for k, v in want.items() if v is None}
    assert len([v for v in want.values() if v is None]) > 20 and len([v for v in want.values() if v and len(v) == 2]) > 20


@pytest.mark.parametrize(
    ("spans", "reason"),
    [
        ([], "invalid-token-span"), ([(0, 0)], "invalid-token-span"), ([(0, 3), (2, 4)], "invalid-token-span"), ([(0, 3), (0, 3)], "invalid-token-span"), ([(-1, 2)], "invalid-token-span"), ([(0, 9)], "invalid-token-span"),
        ([(0, 3, "abd")], "invalid-token-span"), ([(0, 3, "abc", "q")], "invalid-token-span"), ([(0, 3, "abc", "p"), (4, 7)], None), (None, None), ([(None, 3)], "invalid-token-span"),
    ],
)
def test_spans_are_checked(spark, spans, reason):
    full = spans if spans is None else [tuple(list(s) + [None] * (8 - len(s))) for s in spans]
    row = (0, "o", "p", "abc def", 0.0, 0.1, 0.7, 0.02, full, None, None, None, None, None)
    got, unresolved = bands.expanded(spark.createDataFrame([row], OBS), ["page"])
    assert [r.reason for r in unresolved.collect()] == ([reason] if reason else [])
    if reason is None:
        (band,) = got.collect()
        assert band.parent_id == "p" and abs(band.width - 0.7) < 1e-9 and [c.text for c in band.cells] == (["abc", "def"] if spans else ["abc def"])


def test_a_cut_answer_gives_the_rows_before_the_cut(spark):
    row = lambda n: json.dumps({"label": f'a{n} "{{[" \\ x', "value": str(n), "unit": None, "reference_interval": "1-2", "flag": ""})
    whole = '{"note":"{","rows":[' + ", ".join(row(n) for n in range(3)) + "]}"
    ends = [whole.index(row(n)) + len(row(n)) for n in range(3)]
    cuts = [(i, whole[:i]) for i in range(len(whole))]
    got = {r.i: r for r in recovery.recovered_answers(spark.createDataFrame(cuts, "i int, raw string"), "raw").collect()}
    for i, r in got.items():
        n = sum(i >= e for e in ends)
        assert len(r["rows"] or []) == n and r.status == ("recovered" if n else "invalid") and r.n_complete == n, i
        assert [x.label for x in r["rows"] or []] == [f'a{k} "{{[" \\ x' for k in range(n)]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (None, ("invalid", 0, 0, 0, None, 0)), ("", ("invalid", 0, 0, 0, None, 0)), ('{"rows":[]', ("invalid", 0, 0, 0, None, 0)), ("{'rows':[%1", ("recovered", 1, 1, 0, None, 0)), ('{"rows":[%1],"rows":[%2', ("recovered", 1, 1, 0, None, 0)),
        ('{"rows":[%1,%2,%1,%2', ("recovered", 2, 4, 0, 2, 2)), ('{"rows":[{"a":%1,%2', ("recovered", 2, 2, 1, None, 0)), ('{"rows":[{"label":"..."},%1', ("recovered", 1, 2, 1, None, 0)), ('{"rows":[' + ",".join(f"%{k}" for k in range(100, 190)), ("recovered", 80, 90, 0, None, 10)),
    ],
)
def test_broken_answers(spark, raw, want):
    item = lambda n: json.dumps({"label": f"l{n}", "value": None, "unit": None, "reference_interval": None, "flag": None})
    if raw:
        for n in [*range(100, 190), 1, 2]:
            raw = raw.replace(f"%{n}", item(n))
    r = recovery.recovered_answers(spark.createDataFrame([(raw, 1)], "raw string, rows int"), "raw").first()
    assert (r.status, len(r["rows"] or []), r.n_complete, r.n_rejected, r.repeated_row, r.n_aside) == want


GOOD = {"sourceObservationIds": ["a", "b", "c"], "sourceFields": {"label": "a", "value": "b", "unit": None, "referenceInterval": None, "flag": "c"}, "biomarkerId": "ldl", "specimenType": "serum", "role": "measurement"}
SHORT = {"rowKey": "r1", "labelKey": "c0", "valueKey": "c1", "unitKey": None, "referenceIntervalKey": None, "flagKey": None, "biomarkerId": None, "role": "preserve"}
ROWS = [("b", 0, "row-0", ["a", "b", "c"]), ("b", 1, "row-1", ["d", "e"])]


def _without(d: dict, key: str) -> dict:
    return {k: v for k, v in d.items() if k != key}


@pytest.mark.parametrize(
    ("items", "want"),
    [
        ([GOOD, SHORT], ["row-0", "row-1"]), ({"proposals": [GOOD]}, ["row-0"]), ([GOOD, GOOD, SHORT], ["row-1"]), ([], []), (7, []), ({"other": [GOOD]}, []), ([GOOD] * 25, []), ([None, 5, "x", SHORT], ["row-1"]),
        ([GOOD | {"extra": 1}], []), ([GOOD | {"sourceObservationIds": ["b", "a", "c"]}], []), ([GOOD | {"sourceObservationIds": ["a", "b"]}], []), ([GOOD | {"sourceObservationIds": ["a", "b", 3]}], []), ([GOOD | {"sourceObservationIds": "abc"}], []),
        ([GOOD | {"biomarkerId": "nope"}], []), ([GOOD | {"biomarkerId": None}], []), ([GOOD | {"biomarkerId": 5}], []), ([GOOD | {"proposedBiomarkerId": "ldl"}], []), ([_without(GOOD, "biomarkerId") | {"proposedBiomarkerId": "ldl"}], ["row-0"]),
        ([GOOD | {"specimenType": "hair"}], []), ([GOOD | {"specimenType": None}], []), ([GOOD | {"role": "ignore", "biomarkerId": None}], []), ([GOOD | {"role": "preserve"}], []), ([GOOD | {"role": None}], []), ([_without(GOOD, "role")], ["row-0"]), ([_without(GOOD, "sourceFields")], ["row-0"]),
        ([GOOD | {"sourceFields": {"label": "a", "value": "b"}}], []), ([GOOD | {"sourceFields": GOOD["sourceFields"] | {"unit": "a"}}], []), ([GOOD | {"sourceFields": GOOD["sourceFields"] | {"unit": "d"}}], []), ([GOOD | {"sourceFields": GOOD["sourceFields"] | {"label": None}}], []), ([GOOD | {"sourceFields": []}], []),
        ([SHORT | {"rowKey": "r01"}], []), ([SHORT | {"rowKey": "r2"}], []), ([SHORT | {"valueKey": "c0"}], []), ([SHORT | {"valueKey": "c2"}], []), ([SHORT | {"labelKey": None}], []), ([_without(SHORT, "flagKey")], []), ([SHORT | {"unitKey": 1}], []), ([SHORT | {"sourceFields": None}], []),
    ],
)
def test_proposals(spark, items, want):
    batches = spark.createDataFrame([("b", json.dumps(items)), ("c", "not json"), ("d", None)], "batch_id string, raw string")
    got = proposals.valid_proposals(batches, spark.createDataFrame(ROWS, "batch_id string, position int, row_id string, ids array<string>"), spark.createDataFrame([("ldl",)], "biomarker_id string"))
    assert sorted(r.row_id for r in got.collect()) == want


def test_rows_out_of_order_drop_the_batch(spark):
    make = lambda b, *rows: [(b, i, r, ids) for i, (r, ids) in enumerate(rows)]
    rows = make("fine", ("x", ["a"]), ("y", ["b"])) + make("twice", ("x", ["a"]), ("x", ["b"])) + make("shared", ("x", ["a"]), ("y", ["a"])) + make("long", ("x" * 97, ["a"])) + make("none", ("x", [])) + make("double", ("x", ["a", "a"]))
    got = proposals.given_rows(spark.createDataFrame(rows, "batch_id string, position int, row_id string, ids array<string>"))
    assert sorted((r.batch_id, r.number, r.row_id) for r in got.collect()) == [("fine", 0, "x"), ("fine", 1, "y")]
