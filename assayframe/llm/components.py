"""Connected components by alternating large-star and small-star rounds.

Each round is two joins on a node; minima are combined before the shuffle, and no node's neighbours are
gathered into one value, so a node with very many links is only a skewed join that AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _star(pairs: DataFrame, keep) -> DataFrame:
    """pairs (u, v): link what `keep` selects of each u's neighbourhood to its smallest member."""
    least = pairs.groupBy("u").agg(F.min("v").alias("w"))
    least = least.select("u", F.least("u", "w").alias("m"))
    joined = pairs.join(least, "u")
    return keep(joined, least).where("a <> m").select(F.col("a"), F.col("m").alias("b")).distinct()


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _star(both, lambda joined, least: joined.where("v > u").select(F.col("v").alias("a"), "m"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    return _star(
        down,
        lambda joined, least: joined.select(F.col("v").alias("a"), "m").unionAll(least.select(F.col("u").alias("a"), "m")),
    )


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long), no nulls; self-links and repeats are allowed.

    Returns (node, component) for every node of a link between two different nodes; component is the
    smallest node that can be reached. An empty input gives an empty result.
    """
    edges = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _digest(edges)
    while True:
        edges = durable(_small(_large(edges)))
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
