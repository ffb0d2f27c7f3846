"""Sets and duplicates of rows, in input order where that matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in `order`, with n_duplicates, the number of the others."""
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"), (F.count("*") - 1).alias("n_duplicates"))
    return out.select(*keys, "_first.*", "n_duplicates")


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, at the place (`position`) of its first."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last"), F.min(order).alias("position")).select(*keys, "_last.*", "position")


def drop_conflicts(df: DataFrame, label: list[str], value: str, order: list[str]) -> DataFrame:
    """keep_first over labels that have one value only; all rows of a label with several are dropped."""
    single = df.groupBy(*label).agg(F.min(value).alias("_low"), F.max(value).alias("_high")).where("_low = _high").select(*label)
    return keep_first(df.join(single, label, "left_semi"), label, order)


def max_multiplicity(df: DataFrame, group: list[str], band: str, key: str, order: list[str]) -> DataFrame:
    """Each key as often as in the band that has it most: the n-th occurrence is that of the first band that has one."""
    nth = F.row_number().over(Window.partitionBy(*group, band, key).orderBy(*order))
    numbered = df.withColumn("occurrence", nth)
    return numbered.groupBy(*group, key, "occurrence").agg(F.min(band).alias(band))


def difference(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on).distinct(), on, "left_anti")


def referenced_only_outside(owned: DataFrame, referenced: DataFrame, path: str, exempt_prefix: str) -> DataFrame:
    """Owned paths that nothing refers to, except those below a prefix."""
    return difference(owned, referenced, [path]).where(~F.col(path).startswith(exempt_prefix))


def reference_counts(sources: list[DataFrame], path: str) -> DataFrame:
    """(path, n): how often each path is referred to over all sources."""
    every = sources[0].select(path)
    for s in sources[1:]:
        every = every.unionByName(s.select(path))
    return every.where(F.col(path).isNotNull()).groupBy(path).agg(F.count("*").alias("n"))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """table with changes: the last change of a key replaces its row. A full join of one row per key each."""
    rest = [c for c in table.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_new"))
    old = table.select(*keys, F.struct(*rest).alias("_old"))
    return old.join(last, keys, "full").select(*keys, F.coalesce("_new", "_old").alias("_row")).select(*keys, "_row.*")


def insert_missing(table: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """table with the rows of new whose key it lacks, the first of each."""
    first = keep_first(new, keys, order).select(*table.columns)
    return table.unionByName(first.join(table, keys, "left_anti"))


def deletion_plan(parents: DataFrame, children: dict[str, tuple[DataFrame, str]], key: str) -> DataFrame:
    """(table, n): rows of each child table that go with the given parents."""
    counts = None
    for name, (child, column) in children.items():
        one = child.join(parents.select(F.col(key).alias(column)).distinct(), column, "left_semi").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def orphans(child: DataFrame, parent: DataFrame, column: str, key: str) -> DataFrame:
    """Rows of child whose column is set and names no row of parent."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def pick_by_state(df: DataFrame, keys: list[str], states: dict[str, int], state: str, order: list[Column]) -> DataFrame:
    """Per key the row with the lowest state, then in `order`. States that aren't listed come last."""
    place = None
    for name, rank in states.items():
        place = F.when(F.col(state) == name, rank) if place is None else place.when(F.col(state) == name, rank)
    place = place.otherwise(max(states.values()) + 1)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(place, *order))).where("_n = 1").drop("_n")
