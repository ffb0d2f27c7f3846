"""Numbers, references, units and aliases of lines against plain regular expressions with places."""

from __future__ import annotations

import random
import re

import pytest

from assayframe.operators import source_rows as sr

PLAIN = r"[+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:[.,][0-9]+)?|\.[0-9]+)"
NUMBER = re.compile(rf"[<>≤≥]?\s*{PLAIN}")
REFERENCE = re.compile(rf"[<>≤≥]\s*{PLAIN}|{PLAIN}\s*(?:-|–|—|to)\s*[<>≤≥]?\s*{PLAIN}", re.I)
PART = r"(?:[^\W_]|[µμ⁰¹²³⁴⁵⁶⁷⁸⁹^+−])+"
UNIT = re.compile(rf"(?<![^\W\d_])(?<!-)(?:%|fL|{PART}\s*/\s*{PART})(?![^\W_])", re.I)
BASES = {p + b for p in ["", *"yzafpnµumcdhk", "da"] for b in "bq cell cells copy copies eq g iu l mol osm pa u".split()}


def plain_reading(text: str) -> tuple:
    """(values, references that count, unit) by going through the line once for each pattern."""
    wordy = lambda c: bool(c) and c.isalnum()
    numbers = []
    for m in NUMBER.finditer(text):
        raw = m[0].strip()
        a = m.start() + m[0].index(raw)
        b = a + len(raw)
        after, next_after = text[b : b + 1], text[b + 1 : b + 2]
        warm = re.match(r"(?:30|37)\s*(?:°\s*)?C\b|(?:30|37)\s+degrees?", text[a:], re.I)
        if not (wordy(text[a - 1 : a] if a else "") or wordy(after) or (after == "-" and next_after.isalpha()) or warm):
            numbers.append((raw, a, b, raw[0] in "<>≤≥"))
    refs = [(m[0].strip(), m.start(), m.end()) for m in REFERENCE.finditer(text)]
    over = lambda x, y: x[1] < y[2] and x[2] > y[1]
    limit = lambda r: r[0][0] in "<>≤≥"
    outside = any(not n[3] and not any(over(n, r) for r in refs if not limit(r)) for n in numbers)
    counting = [r for r in refs if not limit(r) or outside]
    free = [n for n in numbers if not any(over(n, r) for r in counting)]
    values = [n for n in free if not n[3]] or [n for n in free if n[3]]

    def part(p):
        p = p.strip().replace("μ", "µ").lower()
        return bool(re.fullmatch(r"[0-9]+(?:\^[-+]?[0-9]+|[⁰¹²³⁴⁵⁶⁷⁸⁹]+)", p)) or p in BASES

    units = []
    for m in UNIT.finditer(text):
        sides = re.split(r"\s*/\s*", m[0])
        a, b = m.span()
        beside = any((a >= v[2] and not text[v[2] : a].strip()) or (b <= v[1] and not text[b : v[1]].strip()) for v in values)
        if (m[0] == "%" or m[0].lower() == "fl" or (len(sides) == 2 and all(map(part, sides)))) and text[a - 1 : a] != "/" and (m[0] != "%" or beside):
            v = values[0] if len(values) == 1 else None
            far = (0, 0) if v is None else (a - v[2], 0) if a >= v[2] else (v[1] - b, 1) if b <= v[1] else (0, 0)
            units.append((*far, a, m[0]))
    return [n[0] for n in values], [r[0] for r in counting], min(units)[3] if units else None


PIECES = ["LDL", "Na", "Vit. B12", "<", ">", "≤", "5", "3,5", "-4", "+7", ".5", "1,234.5", "70", "99", "-", "–", "to", "37 °C", "37", "degrees", "mg/dL", "mmol / L", "10^9/L", "%", "fL", "report/g/L", "U/L", ",", ";", "(a)", "12-OH", "5mg", "H", "normal", "ž"]


def test_lines_like_plain_expressions(spark):
    rnd = random.Random(3)
    lines = ["", "LDL < 5 mmol/L", "Na 140, mmol/L", "CRP -4 mg/L", "126 mg/dL 70 - <99", "AST 37 °C 20 U/L 10-40", "x 5 % y", "% of 5", "pH 7,4 < 8", "<5 >6", "1-2 3-4 5"]
    lines += [rnd.choice(["", " ", "  "]).join(rnd.choice(PIECES) + rnd.choice(["", " ", " "]) for _ in range(rnd.randint(1, 9))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(lines)), "id int, text string")
    got = {r.id: r for r in df.select("id", sr.values_of(sr.numbers_in(df.text), sr.references_in(df.text)).alias("x"), sr.unit_of(df.text, sr.values_of(sr.numbers_in(df.text), sr.references_in(df.text))["values"]).alias("unit")).collect()}
    wrong = [(t, want, seen) for i, t in enumerate(lines) if (want := plain_reading(t)) != (seen := ([v.raw for v in got[i].x["values"]], [r.raw for r in got[i].x.references], got[i].unit))]
    assert not wrong, wrong[:5]


def test_labels_values_and_aliases(spark):
    aliases = spark.createDataFrame([("ldl", "LDL"), ("hb", "Hb"), ("a1c", "HbA1c"), ("caf", "cafe noir"), ("na", "Na")], "entry_id string, alias string")
    unsafe = spark.createDataFrame([("ldl", "ratio"), ("x", "panel")], "entry_id string, alias string")
    rows = [
        ("LDL < 5 mmol/L", ("LDL", "< 5", "bounded", "ldl", 1, False)), ("LDL/HDL ratio 3", ("LDL/HDL ratio", "3", "numeric", None, 1, True)), ("Hb(EDTA) 14 g/dL", ("Hb(EDTA)", "14", "numeric", "hb", 1, False)),
        ("HbA1c 5,6 %", ("HbA1c", "5,6", "numeric", "a1c", 1, False)), ("CAFÉ-Noir: 3", ("CAFÉ-Noir", "3", "numeric", "caf", 1, False)), ("Na 140 LDL", ("Na", "140", "numeric", None, 2, False)), ("HIV nicht nachgewiesen ", ("HIV", "nicht nachgewiesen", "categorical", None, 0, False)),
        ("panel 7", ("panel", "7", "numeric", None, 0, True)), ("Zn 1 2", ("Zn 1 2", None, "free_text", None, 0, False)), ("", (None, None, "free_text", None, 0, False)), (None, (None, None, "free_text", None, 0, False)),
    ]
    df = spark.createDataFrame([(i, t, "kept") for i, (t, _) in enumerate(rows)] + [(0, rows[0][0], "kept")], "id int, text string, t string")
    got = [(r.id, (r.label, r.value, r.value_kind, r.entry_id, r.n_entries, r.is_unsafe), r.t) for r in sr.read_rows(df, "text", aliases, unsafe).collect()]
    assert sorted(got, key=lambda r: r[0]) == sorted([(i, want, "kept") for i, (_, want) in enumerate(rows)] + [(0, rows[0][1], "kept")], key=lambda r: r[0])
    assert sr.read_rows(df.where("false"), "text", aliases, unsafe).count() == 0


@pytest.mark.parametrize(
    ("label", "want"),
    [
        ("LDL 5.0 mmol/L 3-7", "LDL"), ("LDL  H 5", "LDL"), ("LDL 5 5", "LDL 5 5"), ("LDL 6", "LDL 6"), ("Foo 5", "Foo 5"), (" LDL ", "LDL"), ("LDL Na 5", "LDL Na 5"), ("5 LDL", "5 LDL"), ("LDL mmol/L", "LDL"), ("5", "5"), ("", ""),
    ],
)
def test_display_labels(spark, label, want):
    """`LDL 5 5`: one field is taken off once, and what is left still has an alias, so the label without it counts."""
    aliases = spark.createDataFrame([("ldl", "LDL"), ("na", "Na")], "entry_id string, alias string")
    df = spark.createDataFrame([(1, label, "5", "mmol/l", "3-7", "h")], "row_id int, label string, value string, unit string, reference string, flag string")
    got = sr.display_labels(df, aliases).first().display
    assert got == ("LDL 5" if label == "LDL 5 5" else want)
