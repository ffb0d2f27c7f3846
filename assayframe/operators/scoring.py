"""Scoring produced rows against expected ones."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import neat

#: What must agree in each pass, strictest first. A null page agrees with a null one; rows without a date stay out of the pass by date.
PASSES = (("page", "value"), ("page",), ("date",), ())
#: What a matching produced row is preferred for.
WEIGHTS = {"date": 100, "specimen": 10, "page": 5, "unit": 2}


def match_cascade(expected: DataFrame, produced: DataFrame) -> DataFrame:
    """One-to-one pairs (report_id, expected_idx, produced_idx, pass).

    Both sides: report_id, idx, label, page, value, date, specimen, unit. Only rows of one report and label can match, so a group of these goes
    through all passes by itself: one shuffle. White space doesn't count, nor does a label's case. Within a pass and key, expected rows take in their order the free produced row with the most
    weight, on a tie the first. Rows without a label match nothing.
    """
    columns = ["label", "page", "value", "date", "specimen", "unit"]
    side = lambda df, name: df.select(F.col("report_id").cast("string").alias("report_id"), F.lit(name).alias("side"), F.col("idx").cast("long").alias("idx"), *[neat(F.col(c).cast("string"), lower=c == "label").alias(c) for c in columns])
    both = side(expected, "e").unionByName(side(produced, "p")).where("label is not null")
    return both.select(*_ROW).repartition("report_id", "label").sortWithinPartitions("report_id", "label", "side", "idx").mapInArrow(_matches, "report_id string, expected_idx long, produced_idx long, pass int")


_ROW = ["report_id", "label", "side", "idx", "page", "value", "date", "specimen", "unit"]
_PAIRS = pa.schema([("report_id", pa.string()), ("expected_idx", pa.int64()), ("produced_idx", pa.int64()), ("pass", pa.int32())])


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by report and label; a group of these at a time."""
    rows = (row for batch in batches for row in batch.to_pylist())
    out: list[tuple] = []
    for _, group in groupby(rows, key=lambda r: (r["report_id"], r["label"])):
        out += _matched(list(group))
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_pylist([dict(zip(_PAIRS.names, o, strict=True)) for o in out], _PAIRS)
            out = []
    yield pa.RecordBatch.from_pylist([dict(zip(_PAIRS.names, o, strict=True)) for o in out], _PAIRS)


def _matched(rows: list[dict]) -> list[tuple]:
    """All passes over the rows of one report and label."""
    wanted, free, out = [r for r in rows if r["side"] == "e"], [r for r in rows if r["side"] == "p"], []
    for n, keys in enumerate(PASSES):
        held: dict[tuple, list[dict]] = {}
        for p in free:
            held.setdefault(tuple(p[k] for k in keys), []).append(p)
        unmatched = []
        for e in wanted:
            key = tuple(e[k] for k in keys)
            known = all(v is not None for k, v in zip(keys, key, strict=True) if k == "date")
            candidates = held.get(key, []) if known else []
            if not candidates:
                unmatched.append(e)
                continue
            weight = [sum(w for c, w in WEIGHTS.items() if p[c] == e[c] and (c == "page" or e[c] is not None)) for p in candidates]
            p = candidates.pop(weight.index(max(weight)))
            out.append((e["report_id"], e["idx"], p["idx"], n + 1))
        wanted, used = unmatched, {o[2] for o in out}
        free = [p for p in free if p["idx"] not in used]
    return out


def field_status(expected: Column, produced: Column, ambiguous: Column) -> Column:
    """`unresolved` where the truth itself is ambiguous; else whether the two agree, null with null included."""
    return F.when(ambiguous, "unresolved").when(expected.eqNullSafe(produced), "correct").otherwise("incorrect")


def field_confusion(matched: DataFrame, fields: list[str], ambiguous: Column) -> DataFrame:
    """(field, correct, incorrect, unresolved, denominator); matched has e_<field> and p_<field>, ambiguous an array of field names."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), field_status(F.col(f"e_{f}"), F.col(f"p_{f}"), F.array_contains(ambiguous, f)).alias("status")) for f in fields])).alias("s")
    long = matched.select(each).select("s.*")
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    return long.groupBy("field").agg(n("correct").alias("correct"), n("incorrect").alias("incorrect"), n("unresolved").alias("unresolved"), F.count("*").alias("denominator"))


def pairwise_agreement(matched: DataFrame, expected: str, actual: str) -> DataFrame:
    """One row: over all pairs of rows, whether both groupings put them together (or apart) alike; pairs with a null are unresolved.

    From counts of groups instead of pairs: with T pairs, E, A and J together by either and by both, correct is J + T - E - A + J.
    """
    pairs = lambda n: (n * (n - 1) / 2)
    known = matched.where(F.col(expected).isNotNull() & F.col(actual).isNotNull())
    joint = known.groupBy(expected, actual).agg(F.count("*").alias("n"))
    of = lambda by, name: joint.groupBy(by).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias(name))
    both = joint.agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("j"), F.coalesce(F.sum("n"), F.lit(0)).alias("known"))
    every = matched.agg(F.count("*").alias("m"))
    row = both.crossJoin(of(expected, "e")).crossJoin(of(actual, "a")).crossJoin(every)  # four single rows
    t = pairs(F.col("known"))
    correct = 2 * F.col("j") + t - F.col("e") - F.col("a")
    return row.select(correct.cast("long").alias("correct"), (t - correct).cast("long").alias("incorrect"), (pairs(F.col("m")) - t).cast("long").alias("unresolved"))


def surplus(expected: DataFrame, produced: DataFrame, keys: list[str]) -> DataFrame:
    """One row: duplicates (produced beyond the expected number, at least one) and spurious (produced without any expected), over keys compared null-safely."""
    e = expected.groupBy(*keys).agg(F.count("*").alias("n_expected"))
    p = produced.groupBy(*keys).agg(F.count("*").alias("n_produced"))
    on = None
    for k in keys:
        same = p[k].eqNullSafe(e[k])
        on = same if on is None else on & same
    met = p.join(e, on, "left").withColumn("_e", F.coalesce(e["n_expected"], F.lit(0)))
    return met.agg(F.coalesce(F.sum(F.greatest(F.lit(0), F.col("n_produced") - F.greatest(F.lit(1), F.col("_e")))), F.lit(0)).alias("duplicates"), F.coalesce(F.sum(F.when(F.col("_e") == 0, F.col("n_produced"))), F.lit(0)).alias("spurious"))


def validated(proposals: DataFrame, envelope: str, codes: list[tuple[str, Column]]) -> DataFrame:
    """proposals with `code`, the first failure that holds, and `accepted`: whether no proposal of the envelope has failed."""
    code = None
    for name, condition in codes:
        code = F.when(condition, name) if code is None else code.when(condition, name)
    coded = proposals.withColumn("code", code)
    bad = coded.where("code is not null").select(envelope).distinct().withColumn("_bad", F.lit(True))
    return coded.join(bad, envelope, "left").withColumn("accepted", F.col("_bad").isNull()).drop("_bad")


def comparison_issues(runs: DataFrame) -> DataFrame:
    """(report_id, issue): reports whose runs don't share hash and expected set, or have one pipeline version twice."""
    shared = runs.groupBy("report_id").agg(F.min("sha256").alias("h0"), F.max("sha256").alias("h1"), F.min("n_expected").alias("e0"), F.max("n_expected").alias("e1"))
    differs = shared.select("report_id", F.explode(F.array_compact(F.array(F.when(F.col("h0") != F.col("h1"), "hash"), F.when(F.col("e0") != F.col("e1"), "expected")))).alias("issue"))
    twice = runs.groupBy("report_id", "pipeline_id", "version").count().where("count > 1").select("report_id", F.lit("repeated").alias("issue"))
    return differs.unionByName(twice).distinct()
