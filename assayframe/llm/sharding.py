"""Sharding by extendible hashing: a directory of hash-prefix bits in which only oversized buckets split.

A row's path is the bits of its hash. A bucket, a prefix of bits, holds all rows whose path begins with it; it splits on its next bit only if
its bytes exceed the limit. The directory is made in levels of `LEVEL_BITS` bits: one aggregation sums the bytes of a level's
cells, and the shortest prefix that fits is each cell's shard. Rows of cells that are too large even so, and no
others, go on to the next level. The first level has at most 2**LEVEL_BITS cells, so it is broadcast; later ones are plain joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, table

LEVEL_BITS = 12
#: Bits of one 64-bit hash that are used; then a second hash, which tells identical rows apart, goes on.
LEVELS_OF_HASH = 5


def _cell(level: int, h: str, h2: str) -> Column:
    """The bits of a level, as a string of digits; h and h2 name the columns of the two hashes."""
    of, at = (h, level) if level < LEVELS_OF_HASH else (h2, level - LEVELS_OF_HASH)
    bits = F.shiftrightunsigned(of, 64 - LEVEL_BITS * (at + 1)).bitwiseAND((1 << LEVEL_BITS) - 1)
    return F.lpad(F.bin(bits), LEVEL_BITS, "0")


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs as (doc, bytes, h, h2): all columns as a struct; h2 goes on where identical rows have equal h.

    To be written before it is used: h2 depends on a row's place in its partition, which a second run may change.
    """
    text = docs[text_col].cast("string")
    h = F.xxhash64(docs[id_col].cast("long"), F.xxhash64(text))
    sized = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), h.alias("h"))
    return sized.withColumn("h2", F.xxhash64("h", F.monotonically_increasing_id()))


def _split(cells: DataFrame, limit: int, root: bool) -> DataFrame:
    """cells (path, cell, n, bytes): those that fit as (path, cell, shard, shard_bytes, shard_rows), under their shortest prefix that fits."""
    depths = F.sequence(F.lit(0 if root else 1), F.lit(LEVEL_BITS))
    prefixes = cells.withColumn("depth", F.explode(depths)).withColumn("prefix", F.substring("cell", F.lit(1), F.col("depth")))
    bucket = Window.partitionBy("path", "depth", "prefix")
    sums = prefixes.withColumn("total", F.sum("bytes").over(bucket)).withColumn("rows", F.sum("n").over(bucket))
    fits = sums.where((F.col("total") <= limit) | (F.col("rows") == 1))
    least = fits.groupBy("path", "cell").agg(F.min(F.struct("depth", "prefix", "total", "rows")).alias("s"))
    return least.select("path", "cell", F.concat("path", "s.prefix").alias("shard"), F.col("s.total").alias("shard_bytes"), F.col("s.rows").alias("shard_rows"))


def directory(rows: DataFrame, limit: int) -> list[DataFrame]:
    """The directory's levels, each (path, cell, shard, shard_bytes, shard_rows); path is the cell of the levels above. rows (bytes, h, h2) are stored ones."""
    rows, levels = rows.select("bytes", "h", "h2", F.lit("").alias("path")), []
    while len(levels) < 2 * LEVELS_OF_HASH:
        rows = rows.withColumn("cell", _cell(len(levels), "h", "h2"))
        cells = table(rows.groupBy("path", "cell").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")), "cells")
        levels.append(table(_split(cells, limit, not levels), "directory"))
        large = cells.join(levels[-1], ["path", "cell"], "left_anti").select("path", "cell")
        if large.isEmpty():
            break
        rows = durable(rows.join(large, ["path", "cell"]).select("bytes", "h", "h2", F.concat("path", "cell").alias("path")))
    return levels


def attach(rows: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """rows (doc, bytes, h, h2) with shard, shard_bytes and shard_rows from the directory made of them."""
    found = ("shard", "shard_bytes", "shard_rows")
    out = rows.select("*", F.lit("").alias("path"), F.lit(None).cast("string").alias("shard"), F.lit(None).cast("long").alias("shard_bytes"), F.lit(None).cast("long").alias("shard_rows"))
    for k, level in enumerate(levels):
        known = level.select("path", "cell", *[F.col(c).alias(f"new_{c}") for c in found])
        met = out.withColumn("cell", _cell(k, "h", "h2")).join(F.broadcast(known) if k == 0 else known, ["path", "cell"], "left")
        out = met.select("doc", "bytes", "h", "h2", F.concat("path", "cell").alias("path"), *[F.coalesce(c, f"new_{c}").alias(c) for c in found])
    return out.select("doc", "bytes", *found)


def assign(docs: DataFrame, limit: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, shard, depth, shard_bytes, shard_rows), a row for each row of docs.

    shard is the bucket's bits, '' where everything fits one. A shard has at most `limit` bytes of text, unless it is one row that alone is larger;
    a long text is only measured. A null text has no bytes; null ids hash like any value. Repeated rows share a hash and are told apart
    by a second one if they don't fit one shard. An empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    hashed = _hashed(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), "doc_id", "text")
    rows = table(hashed.select(F.struct(F.col("doc.doc_id").alias("doc_id")).alias("doc"), "bytes", "h", "h2"), "hashed")
    found = attach(rows, directory(rows, limit))
    return found.select("doc.doc_id", F.col("bytes").alias("n_bytes"), "shard", F.length("shard").alias("depth"), "shard_bytes", "shard_rows")


def write_shards(docs: DataFrame, path: str, limit: int, *, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs, with its columns, below path, a folder `shard=<bits>` for each shard ('root' where everything fits one).

    Cases are those of assign(). A column of docs named `shard` is refused: the folders would hide it.
    """
    if "shard" in docs.columns:
        raise ValueError("a column named 'shard' would be hidden by the folders' names")
    rows = table(_hashed(docs, id_col, text_col), "hashed")
    named = attach(rows, directory(rows, limit)).select("doc.*", F.when(F.col("shard") == "", "root").otherwise(F.concat(F.lit("b"), "shard")).alias("shard"))
    named.repartition("shard").write.partitionBy("shard").parquet(path)
