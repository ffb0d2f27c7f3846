"""Name an intermediate value inside a Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once per row; without it each use would repeat the whole expression in generated code."""
    return F.transform(F.array(value), body)[0]
