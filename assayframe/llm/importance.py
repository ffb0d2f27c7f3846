"""Target-distribution importance resampling: draw the documents whose hashed n-grams look most like a target's.

Every run of one to three words is a feature, counted in one of 10,000 buckets. A bucket's gain is the log ratio of its share in the target to its
share in the documents, a document's weight the sum of its features' gains, and the draw takes the highest weights after Gumbel noise, which is
sampling without replacement in proportion to the importance.

Higher-order functions make each document's array of buckets once; it is stored. Scoring aggregates over element_at of a literal array of 10,000
gains, so no feature ever becomes a row and documents aren't shuffled: only bucket totals are, and ids and scores for the ranks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scans import numbered
from .common import bounded_batches, record_batch, table

BUCKETS = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: all of ASCII but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; null: none."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, BETWEEN), "")


def joined(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: F.concat(a, F.lit(" "), b))


def bucketed(docs: DataFrame, text_col: str) -> DataFrame:
    """docs (id columns kept, text_col replaced) with n_words and `buckets`, the bucket of each run of one to three words, repeats included."""
    others = [c for c in docs.columns if c != text_col]
    listed = docs.select(*others, words(docs[text_col]).alias("_w"))
    n = F.size("_w")
    twos = listed.select(*others, "_w", joined(F.slice("_w", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("_w", F.lit(2), F.greatest(n - 1, F.lit(0)))).alias("_ww"))
    threes = joined(F.slice("_ww", F.lit(1), F.greatest(n - 2, F.lit(0))), F.slice("_w", F.lit(3), F.greatest(n - 2, F.lit(0))))
    hashed = F.transform(F.concat("_w", "_ww", threes), lambda x: (F.crc32(x.cast("binary")) % BUCKETS).cast("int"))
    return twos.select(*others, n.cast("long").alias("n_words"), hashed.alias("buckets"))


def totals(lists: DataFrame, name: str) -> DataFrame:
    """(bucket, name): how often each bucket occurs in the arrays. Each task counts its own arrays, so that at most 10,000 rows of each are shuffled."""
    bounded_batches(lists.sparkSession)
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            seen += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=BUCKETS)
        found = np.flatnonzero(seen)
        yield record_batch(schema, [found.astype(np.int32), seen[found]])

    return lists.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def gains(source: DataFrame, target: DataFrame) -> list[int]:
    """The gain of each bucket, in thousandths: 10,000 numbers whatever the size of the data."""
    spark = source.sparkSession
    counts = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(totals(source, "s"), "bucket", "left").join(totals(target, "t"), "bucket", "left").na.fill(0).collect()
    by = {r["bucket"]: (r["s"], r["t"]) for r in counts}
    s, t = (np.array([by[b][k] for b in range(BUCKETS)], np.float64) for k in (0, 1))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64).tolist()


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, a function of seed and id alone."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long").cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def score(lists: DataFrame, bucket_gains: list[int], seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of lists (doc_id, n_words, buckets)."""
    literal = F.split(F.lit(",".join(map(str, bucket_gains))), ",").cast("array<long>")
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + F.element_at(literal, b + 1))
    return lists.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 5, least_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs; rank counts the drawn ones from 1, others have null.

    Drawn are the floor(percent * N / 100) highest scores of the N rows with at least least_words words; ties go to the smaller id, a null id before
    all others. A null or empty text has no features, weight 0, and is not drawn unless least_words is 0. Rows that are repeated have the same score and
    follow each other in any order. Empty docs give no rows; an empty target gives gains that only reflect how common buckets are in docs. Texts of any
    length are scored whole. Other columns of both tables are ignored, whatever their names. The id keeps its type.
    """
    stored = table(bucketed(docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")), "text"), "buckets")
    wanted = bucketed(target.select(target[target_text_col].cast("string").alias("text")), "text")
    scored = table(score(stored, gains(stored, wanted), seed), "scores")
    eligible = scored.where(F.col("n_words") >= least_words)
    n_drawn = eligible.count() * percent // 100
    ranked = numbered(eligible, [F.col("score").desc(), F.col("doc_id").asc_nulls_first()], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= n_drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*rest.columns).unionByName(rest)
