"""The order of a locale beside that of code points."""

from __future__ import annotations

from assayframe.operators import scans


def test_both_orders(spark):
    words = ["zebra", "Äpfel", "apfel", "Zoo", "Birne", "éclair", "Echo", "ähnlich", "10", "_x"]
    df = spark.createDataFrame([("g", w) for w in words] + [("h", None)], "g string, w string")
    local = [r.w for r in df.where("g = 'g'").orderBy(scans.locale_key(df.w)).collect()]
    assert local == ["_x", "10", "ähnlich", "apfel", "Äpfel", "Birne", "Echo", "éclair", "zebra", "Zoo"]
    assert [r.w for r in df.where("g = 'g'").orderBy("w").collect()] == sorted(words)
    got = {r.g: tuple(r)[1:] for r in scans.ends_of_order(df, ["g"], "w").collect()}
    assert got == {"g": ("_x", "Zoo", "10", "éclair"), "h": (None, None, None, None)}
