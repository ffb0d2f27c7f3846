"""Faults of diagnostics payloads, and folds in other orders."""

from __future__ import annotations

import json
import random

import pytest

from assayframe.operators import clustering, diagnostics

GOOD = {"schema": "d", "app": {"version": "1", "variant": "preview"}, "platform": {"name": "ios", "osMajor": None}, "capabilities": {"localStorage": "available", "protectedFiles": "unknown"}, "failures": []}


@pytest.mark.parametrize(
    ("payload", "fault"),
    [
        (GOOD, None), (None, "not-json"), ("{", "not-json"), ([], "not-an-object"), ([{"ID": 1}], "forbidden-key"), (GOOD | {"more": 1}, "unknown-key"), ({k: v for k, v in GOOD.items() if k != "app"}, "incomplete"), (GOOD | {"schema": 1}, "wrong-schema"),
        (GOOD | {"platform": {"name": "ios"}}, "wrong-value"), (GOOD | {"platform": {"name": "ios", "osMajor": 1.5}}, "wrong-value"), (GOOD | {"capabilities": {"localStorage": "maybe", "protectedFiles": "unknown"}}, "wrong-value"),
        (GOOD | {"failures": ["a", "c"]}, "wrong-failure"), (GOOD | {"failures": {}}, "wrong-failure"), (GOOD | {"failures": [{"deep": [{"Path": 1}]}]}, "forbidden-key"), (GOOD | {"app": {"version": 'a "id": b', "variant": "preview"}}, None),
    ],
)
def test_faults(spark, payload, fault):
    raw = payload if payload is None or isinstance(payload, str) else json.dumps(payload)
    got = diagnostics.with_fault(spark.createDataFrame([(raw, 1)], "raw string, fault int"), "raw", "d", ["a", "b"]).first()
    assert got.fault == fault


def test_rows_around_the_first_mean_in_reach(spark):
    rnd = random.Random(1)
    cells = [(p, i, rnd.uniform(0, 40), rnd.uniform(1, 30)) for p in range(8) for i in range(rnd.randint(1, 40))]
    want = {}
    for p in range(8):
        groups: list[list[float]] = []
        for _, i, at, size in sorted((c for c in cells if c[0] == p), key=lambda c: (c[2], c[1])):
            hit = next((g for g in groups if abs(sum(g) / len(g) - at) <= max(1.25, size * 0.35)), None)
            if hit is None:
                groups.append(hit := [])
            hit.append(at)
            want[p, i] = next(n for n, g in enumerate(groups, 1) if g is hit)
    rnd.shuffle(cells)
    got = clustering.mean_rows(spark.createDataFrame(cells, "p int, i int, at double, size double").repartition(3), ["p"], "at", "size", "i")
    assert {(r.p, r.i): r.line for r in got.collect()} == want
