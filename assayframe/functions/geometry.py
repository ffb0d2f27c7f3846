"""Boxes on a page: x, y, width and height as fractions of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two intervals share."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Distance of two intervals, zero if they meet."""
    return F.greatest(F.lit(0.0), F.greatest(a0, b0) - F.least(a1, b1))


def center(start: Column, size: Column) -> Column:
    return start + size / 2


def same_band(y1: Column, h1: Column, y2: Column, h2: Column) -> Column:
    """Two boxes are on one line: they overlap by a fifth of the lower one, or their centres are close."""
    shared = overlap(y1, y1 + h1, y2, y2 + h2) / F.greatest(F.least(h1, h2), F.lit(1e-9))
    return (shared >= 0.2) | (F.abs(center(y1, h1) - center(y2, h2)) <= 0.7 * F.greatest(h1, h2))


def continuity_gap(height: Column) -> Column:
    """How far apart the cells of one row may be."""
    return F.greatest(F.lit(0.2), F.least(F.lit(0.45), 8 * height))


def part_of_box(x: Column, width: Column, start: Column, end: Column, length: Column) -> Column:
    """(x, width) of characters start..end of a text of `length` characters in the box."""
    n = F.greatest(length, F.lit(1))
    return F.struct((x + width * start / n).alias("x"), (width * (end - start) / n).alias("width"))


def turned(x: Column, y: Column, width: Column, height: Column, rotation: Column) -> Column:
    """The box on a page turned clockwise by 0, 90, 180 or 270 degrees."""
    box = lambda a, b, c, d: F.struct(a.alias("x"), b.alias("y"), c.alias("width"), d.alias("height"))
    return F.when(rotation == 90, box(1 - y - height, x, height, width)).when(rotation == 180, box(1 - x - width, 1 - y - height, width, height)).when(rotation == 270, box(y, 1 - x - width, height, width)).otherwise(box(x, y, width, height))


def union_box(x: Column, y: Column, width: Column, height: Column) -> list[Column]:
    """Aggregates: the box around a group's boxes."""
    return [F.min(x).alias("x"), F.min(y).alias("y"), (F.max(x + width) - F.min(x)).alias("width"), (F.max(y + height) - F.min(y)).alias("height")]


def overlapping_bands(height: Column, band: int, stride: int, keep_height: bool = False) -> Column:
    """array<struct<top, bottom>> of bands that cover a page of `height` rows, each `band` high, a new one each `stride`.

    The last one is clipped at the page's end, or with keep_height moved up to it.
    """
    starts = F.sequence(F.lit(0).cast("int"), F.greatest(height.cast("int") - 1, F.lit(0)), F.lit(stride))
    needed = F.filter(starts, lambda s: (s == 0) | (s + (band - stride) < height))
    if keep_height:
        needed = F.transform(needed, lambda s: F.least(s, F.greatest(height.cast("int") - band, F.lit(0))))
    return F.transform(needed, lambda s: F.struct(s.alias("top"), F.least(s + band, height.cast("int")).alias("bottom")))
