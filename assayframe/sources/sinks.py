"""Exports: canonical JSON, guarded CSV, and a manifest of what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_json, csv_cell


def json_lines(df: DataFrame) -> DataFrame:
    """(value): a JSON object for each row, keys in alphabetical order, nulls kept."""
    return df.select(canonical_json(*[F.col(c) for c in sorted(df.columns)]).alias("value"))


def csv_line(columns: list[Column]) -> Column:
    """A CSV line: every cell quoted, formulas made harmless, nulls as NULL."""
    return F.concat_ws(",", *[csv_cell(c.cast("string")) for c in columns])


def csv_lines(df: DataFrame) -> DataFrame:
    """(value): a CSV line for each row."""
    return df.select(csv_line([df[c] for c in df.columns]).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.text(path)


def manifest(outputs: dict[str, DataFrame]) -> DataFrame:
    """(name, n_rows, n_bytes, sha256): of each output's lines; the digest is of the sorted digests of its lines, so it doesn't depend on partitions.

    Digests are first folded by their first two hexadecimal digits, so that no single value holds all of an output's lines.
    """
    out = None
    for name, lines in outputs.items():
        each = lines.select(F.sha2(F.col("value").cast("binary"), 256).alias("h"), (F.octet_length("value") + 1).cast("long").alias("b"))
        by_prefix = each.groupBy(F.substring("h", 1, 4).alias("p")).agg(F.count("*").alias("n"), F.sum("b").alias("b"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "").cast("binary"), 256).alias("h"))
        one = by_prefix.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("p", "h"))), "").cast("binary"), 256).alias("sha256"))
        one = one.select(F.lit(name).alias("name"), "n_rows", "n_bytes", "sha256")
        out = one if out is None else out.unionByName(one)
    return out
