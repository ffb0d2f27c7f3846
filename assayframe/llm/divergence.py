"""Source divergence audit: how far the word shares of each source lie from those of the other sources of its language.

Terms are counted in DuckDB inside the tasks: first each task's own texts, then, dealt by language and term, each shard's sums. A second deal of the kept
terms, with the totals of their groups joined to them, gives each shard's part of every pair sum and its best terms; Spark adds the sums and merges
the rankings. Arithmetic is in whole numbers throughout.

A pair sum runs over all kept terms, most of which most sources lack. With f0 the value of a term that both lack it is
  V * f0 + sum over terms of g (f with h's least share, less f0) + sum over terms of h (the same from the other side) + a correction for terms of both,
so that shards only pair sources that really share a term, and the two middle sums need just how many terms of a group have which count.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, table

SCALE = 1_000_000_000
#: Bytes of text that a task counts at once.
CHUNK_BYTES = 24 << 20
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

COUNT_TEXTS = rf"""
WITH rows AS (SELECT row_number() OVER () AS r, lang, source, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS terms FROM chunk),
     per_text AS (SELECT r, lang, source, unnest(terms) AS term FROM rows),
     once AS (SELECT r, lang, source, term, count(*) AS n FROM per_text GROUP BY ALL)
SELECT lang, source, term, sum(n)::BIGINT AS n, count(*) AS n_docs FROM once GROUP BY lang, source, term"""

#: One shard: all rows of its (lang, term) are here.
SUM_SHARD = """
WITH summed AS (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(n_docs)::BIGINT AS n_docs FROM chunk GROUP BY ALL)
SELECT lang, source, term, n, (sum(n) OVER one)::BIGINT AS n_lang, (row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1) AS first
FROM summed WINDOW one AS (PARTITION BY lang, term) QUALIFY sum(n_docs) OVER one >= {least_docs}"""

#: A shard's counts with p, the group's share of the term, p0, its share of a term that it lacks, and q, the language's share.
RANK_SHARD = """
WITH ids AS (SELECT lang, source, row_number() OVER ()::INTEGER AS g FROM (SELECT DISTINCT lang, source FROM chunk)),
     terms AS (SELECT lang, term, row_number() OVER ()::INTEGER AS t FROM (SELECT DISTINCT lang, term FROM chunk)),
     c AS (SELECT g, t, p, p0 FROM chunk JOIN ids USING (lang, source) JOIN terms USING (lang, term)),
     pairs AS (
       SELECT a.g AS g, b.g AS h,
         sum((a.p - b.p) * (a.p - b.p) // b.p - (a.p - b.p0) * (a.p - b.p0) // b.p0 - (a.p0 - b.p) * (a.p0 - b.p) // b.p + (a.p0 - b.p0) * (a.p0 - b.p0) // b.p0)::HUGEINT AS value
       FROM c a JOIN c b ON a.t = b.t AND a.g <> b.g GROUP BY 1, 2),
     best AS (SELECT lang, source, term, (p - q) * (p - q) // q AS value FROM chunk WHERE p > q
              QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {top}),
     counts AS (SELECT lang, source, p, count(*) AS value FROM chunk GROUP BY ALL)
SELECT x.lang, x.source, 'pair' AS part, y.source AS item, 0::BIGINT AS p, value::BIGINT AS value FROM pairs JOIN ids x ON x.g = pairs.g JOIN ids y ON y.g = pairs.h
UNION ALL SELECT lang, source, 'term', term, 0, value FROM best
UNION ALL SELECT lang, source, 'count', '', p, value FROM counts"""


def chunked(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.Table]:
    """The batches in tables of about `most` bytes; None: all in one, for a shard, whose size its partition bounds."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if most is not None and size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def in_duckdb(df: DataFrame, sql: str, schema: str, most: int | None = None) -> DataFrame:
    """sql over each task's rows, as `chunk`, in a DuckDB that lives as long as the task, on one thread and without files."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(":memory:", config={"threads": "1", "temp_directory": "", "preserve_insertion_order": "false"}) as db:
            for rows in chunked(batches, most):
                db.register("chunk", rows)
                yield from db.sql(sql).to_arrow_reader(20_000)
                db.unregister("chunk")

    return df.mapInArrow(run, schema)


def share(n: Column, size: Column) -> Column:
    """1 + floor(SCALE * n / size), for n of at most size, in two steps so that no product leaves 64 bits."""
    n, size = n.cast("long"), size.cast("long")
    step = n * F.lit(10_000)  # SCALE is 10,000 times 100,000
    return F.lit(1) + F.call_function("div", step, size) * 100_000 + F.call_function("div", step % size * 100_000, size)


def text_or_empty(docs: DataFrame, column: str) -> Column:
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def audit(docs: DataFrame, *, least_docs: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has every other source of the language, part `term` the `top` terms the source has too often.

    Null texts, languages and sources count as ''. Repeated rows are documents of their own. A group without terms still takes part with the least
    shares; in a language without kept terms pairs have value 0. An empty table gives no rows; a language with one source has no pairs. Ties go to
    the smaller item by UTF-8. Texts of any length are counted whole; one text is one unit of a task. Other columns are ignored, whatever their names.
    """
    rows = docs.select(text_or_empty(docs, lang_col).alias("lang"), text_or_empty(docs, source_col).alias("source"), text_or_empty(docs, text_col).alias("text"))
    counted = in_duckdb(rows, COUNT_TEXTS, "lang string, source string, term string, n long, n_docs long", CHUNK_BYTES)
    kept = table(in_duckdb(counted.repartition("lang", "term"), SUM_SHARD.format(least_docs=least_docs), "lang string, source string, term string, n long, n_lang long, first boolean"), "kept_terms")
    langs = kept.where("first").groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("size_lang"))
    groups = rows.select("lang", "source").distinct().join(kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("n_terms")), ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = table(groups.withColumns({"p0": share(F.lit(1), F.greatest(F.col("size") + F.col("v"), F.lit(1))), "n_lacking": F.col("v") - F.col("n_terms")}), "groups")
    with_shares = kept.join(groups.select("lang", "source", "size", "v", "size_lang", "p0"), ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n") + 1, F.col("size") + F.col("v")).alias("p"), "p0", share(F.col("n_lang") + 1, F.col("size_lang") + F.col("v")).alias("q"))
    parts = table(in_duckdb(with_shares.repartition("lang", "term"), RANK_SHARD.format(top=top), "lang string, source string, part string, item string, p long, value long"), "parts")
    return ranked(parts, groups, top)


def distance(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def ranked(parts: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """Shards' parts added up and merged."""
    g = groups.select("lang", "source", F.col("p0").alias("g0"), "v")
    h = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("h0"))
    both = parts.where("part = 'pair'").select("lang", "source", "item", "value")
    counts = parts.where("part = 'count'").groupBy("lang", "source", "p").agg(F.sum("value").alias("n"))
    # every pair of sources of a language is a row of the result, so this join is no larger than it
    empty = g.join(h, "lang").where("source <> item").select("lang", "source", "item", (F.col("v") * distance("g0", "h0")).alias("value"))
    of_g = counts.join(g, ["lang", "source"]).join(h, "lang").where("source <> item").select("lang", "source", "item", (F.col("n") * (distance("p", "h0") - distance("g0", "h0"))).alias("value"))
    of_h = counts.withColumnRenamed("source", "item").join(h, ["lang", "item"]).join(g, "lang").where("source <> item").select("lang", "source", "item", (F.col("n") * (distance("g0", "p") - distance("g0", "h0"))).alias("value"))
    pairs = both.unionByName(empty).unionByName(of_g).unionByName(of_h).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    found = pairs.unionByName(parts.where("part = 'term'").select("lang", "source", "item", "value", "part"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return found.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
