"""Rows of an answer that breaks off or has trailing text: every object that is complete counts, nothing is filled in.

An answer that decodes as a whole is taken as it is (pages.decoded_answers). Of others the objects after the last `rows` key are read one by one, with regard to
strings, escapes and nesting; in an object that doesn't end, those that begin inside are looked at too.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .pages import ANSWER_FIELDS, LONGEST_FIELD, MOST_ROWS, decoded_answers

_STEP = re.compile(r'["\\{}\[\]]')
#: What a model writes where it copies the form and not the page.
PLACEHOLDER = re.compile(r"(?:\.{3}|…|<\.\.\.|string)\Z")


def span_end(text: str, start: int, opening: str, closing: str) -> int | None:
    """Behind the closing mark that belongs to the opening one at start; None if the text ends before."""
    depth, quoted, at = 0, False, start
    while m := _STEP.search(text, at):
        at = m.end()
        if quoted:
            if m[0] == "\\":
                at += 1
            elif m[0] == '"':
                quoted = False
        elif m[0] == '"':
            quoted = True
        elif m[0] == opening:
            depth += 1
        elif m[0] == closing:
            depth -= 1
            if depth == 0:
                return at
    return None


def objects(text: str, start: int, end: int) -> Iterator[str | None]:
    """The complete objects between two places, in order; None for each one that doesn't end."""
    at = text.find("{", start, end)
    while at >= 0:
        stop = span_end(text, at, "{", "}")
        yield None if stop is None else text[at:stop]
        at = text.find("{", at + 1 if stop is None else stop, end)


def _no_constant(name: str):
    raise ValueError(name)


def row_of(text: str) -> tuple | None:
    """The fields of a row object, trimmed, blank ones None; None if it isn't one."""
    try:
        found = json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None
    if not isinstance(found, dict) or set(found) != set(ANSWER_FIELDS):
        return None
    label, value = found["label"], found["value"]
    bounded = all(v is None or (isinstance(v, str) and len(v) <= LONGEST_FIELD) for v in found.values())
    said = lambda v: v.strip() != "" and not PLACEHOLDER.match(v.strip())
    if not bounded or label is None or not said(label) or (value is not None and not said(value)):
        return None
    return tuple((found[f] or "").strip() or None for f in ANSWER_FIELDS)


def recovered(text: str) -> tuple[list[tuple], int, int, int | None, int]:
    """(rows, complete objects, rejected ones, number of the first repeated one, rows set aside from it on or beyond MOST_ROWS)."""
    rows, complete, rejected, repeated, aside = [], 0, 0, None, 0
    keys = [m.start() for m in re.finditer(r"""["']rows["']\s*:""", text)]
    start = text.find("[", keys[-1]) if keys else -1
    if start < 0:
        return rows, 0, 0, None, 0
    end = span_end(text, start, "[", "]")
    for found in objects(text, start + 1, len(text) if end is None else end - 1):
        row = None if found is None else row_of(found)
        complete += found is not None
        if row is None:
            rejected += 1
        elif repeated is None and row in rows:
            repeated, aside = complete - 1, aside + 1
        elif repeated is not None or len(rows) == MOST_ROWS:
            aside += 1
        else:
            rows.append(row)
    return rows, complete, rejected, repeated, aside


def recovered_answers(answers: DataFrame, raw: str) -> DataFrame:
    """answers with `status` (strict, recovered or invalid), `rows`, n_complete, n_rejected, repeated_row and n_aside.

    Rows from the first repeated one on are set aside: a model that repeats itself has left the page. A null answer is invalid. Columns of these names are replaced.
    """
    item = pa.struct([(f, pa.string()) for f in ANSWER_FIELDS])
    kind = "struct<rows:array<struct<" + ",".join(f"{f}:string" for f in ANSWER_FIELDS) + ">>,n_complete:long,n_rejected:long,repeated_row:long,n_aside:long>"

    @F.pandas_udf(kind)
    def read(texts: pd.Series) -> pd.DataFrame:
        found = [recovered(t or "") for t in texts]
        rows = pa.array([[dict(zip(ANSWER_FIELDS, r, strict=True)) for r in f[0]] for f in found], pa.list_(item)).to_pandas()
        return pd.DataFrame({"rows": rows, **{n: pd.array([f[i] for f in found], "Int64") for i, n in enumerate(("n_complete", "n_rejected", "repeated_row", "n_aside"), 1)}})

    strict = decoded_answers(answers.drop("rows", "error"), raw).withColumnRenamed("rows", "_strict")
    whole = F.col("error").isNull()
    looked = strict.withColumn("_r", F.when(~whole, read(F.col(raw))))
    status = F.when(whole, "strict").when(F.size("_r.rows") > 0, "recovered").otherwise("invalid")
    kept = [c for c in answers.columns if c not in ("status", "rows", "error", "n_complete", "n_rejected", "repeated_row", "n_aside")]
    none = lambda c: F.coalesce(F.col(f"_r.{c}"), F.lit(0).cast("long")).alias(c)
    return looked.select(*kept, status.alias("status"), F.coalesce("_strict", "_r.rows").alias("rows"), none("n_complete"), none("n_rejected"), F.col("_r.repeated_row").alias("repeated_row"), none("n_aside"))


@F.pandas_udf(ArrayType(StringType()))
def complete_objects(texts: pd.Series) -> pd.Series:
    """The complete objects of each text, outermost first."""
    return texts.map(lambda t: [o for o in objects(t or "", 0, len(t or "")) if o is not None])
