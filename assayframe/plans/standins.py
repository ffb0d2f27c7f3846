"""The domain's tables, made from the driver's: orders are records, line items measurements, parts biomarkers, customers subjects.

Each comes as a DataFrame and as SQL for a common table expression with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def records(spark: SparkSession, d: str) -> DataFrame:
    """A record for each order; one in eleven has no date."""
    o = read(spark, d, "orders")
    return o.select(
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderkey").alias("record_id"),
        F.when(F.col("o_orderkey") % 11 != 0, F.to_date("o_orderdate")).alias("collection_date"),
        F.col("o_orderkey").alias("record_ordinal"),
        F.when(F.col("o_orderstatus") == "F", "serum").otherwise("blood").alias("record_specimen"),
    )


RECORDS = """records AS (
  SELECT o_custkey AS subject_id, o_orderkey AS record_id, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS collection_date,
         o_orderkey AS record_ordinal, CASE WHEN o_orderstatus = 'F' THEN 'serum' ELSE 'blood' END AS record_specimen
  FROM orders)"""


def measurements(spark: SparkSession, d: str) -> DataFrame:
    """A measurement for each line item: some bounded, some unmapped, some without unit; brands are biomarkers. Ids hold all that tells line items apart."""
    item, part = read(spark, d, "lineitem"), read(spark, d, "part").select("p_partkey", "p_brand")
    line = F.col("l_linenumber")
    key = F.col("l_orderkey") * 10 + line
    return item.join(part, item["l_partkey"] == part["p_partkey"], "left").select(
        F.col("l_orderkey").alias("record_id"),
        ((key * 100_000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")).alias("measurement_id"),
        ((line.cast("long") * 100_000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")).alias("measurement_ordinal"),
        line.alias("line"),
        F.when(F.col("l_partkey") % 17 != 0, F.col("p_brand")).alias("biomarker_id"),
        F.when(key % 13 == 0, "bounded").when(key % 29 == 0, "categorical").otherwise("numeric").alias("kind"),
        F.col("l_quantity").alias("num"),
        F.when(key % 19 == 0, F.lit(None)).when(line % 3 == 0, "mmol/L").when(key % 31 == 0, "g/L").otherwise("mg/dL").alias("unit"),
        F.when(F.col("l_returnflag") == "N", "needs-review").otherwise("confirmed").alias("review_state"),
        F.when(F.col("l_linestatus") == "F", "serum").otherwise("blood").alias("specimen"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_suppkey").alias("panel"),
    )


MEASUREMENTS = """measurements AS (
  SELECT l_orderkey AS record_id, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey AS measurement_id,
         (CAST(l_linenumber AS BIGINT) * 100000 + l_partkey) * 1000 + l_suppkey AS measurement_ordinal, l_linenumber AS line,
         CASE WHEN l_partkey % 17 <> 0 THEN p_brand END AS biomarker_id,
         CASE WHEN (l_orderkey * 10 + l_linenumber) % 13 = 0 THEN 'bounded' WHEN (l_orderkey * 10 + l_linenumber) % 29 = 0 THEN 'categorical' ELSE 'numeric' END AS kind,
         l_quantity AS num,
         CASE WHEN (l_orderkey * 10 + l_linenumber) % 19 = 0 THEN NULL WHEN l_linenumber % 3 = 0 THEN 'mmol/L' WHEN (l_orderkey * 10 + l_linenumber) % 31 = 0 THEN 'g/L' ELSE 'mg/dL' END AS unit,
         CASE WHEN l_returnflag = 'N' THEN 'needs-review' ELSE 'confirmed' END AS review_state,
         CASE WHEN l_linestatus = 'F' THEN 'serum' ELSE 'blood' END AS specimen, l_returnflag AS flag, l_suppkey AS panel
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)"""


def entries(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue entry for each brand that does not end in 5; specimens are one group, or two where it ends in 1."""
    brand = read(spark, d, "part").select(F.col("p_brand").alias("biomarker_id")).distinct().where(~F.col("biomarker_id").endswith("5"))
    return brand.select("biomarker_id", F.lit("mg/dL").alias("canonical_unit"), F.array(F.lit("mg/dL"), F.lit("mmol/L")).alias("units"), F.col("biomarker_id").endswith("1").alias("two_groups"))


ENTRIES = """entries AS (
  SELECT DISTINCT p_brand AS biomarker_id, 'mg/dL' AS canonical_unit, p_brand LIKE '%1' AS two_groups FROM part WHERE p_brand NOT LIKE '%5')"""


def conversions(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select("biomarker_id", F.lit("mmol/L").alias("from_unit"), F.lit("mg/dL").alias("to_unit"), F.lit(38.67).alias("factor"), F.lit(0.0).alias("offset"))


NORMALIZED = "CASE WHEN unit = 'mg/dL' THEN num WHEN unit = 'mmol/L' THEN round(num * 38.67, 12) END"


def events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events")


def lines(spark: SparkSession, d: str, words: bool = False) -> DataFrame:
    """(doc_id, line, text) of documents; line counts from 0."""
    docs = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return docs.withColumn("line", F.col("line").cast("long"))


LINES = """lines AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS text FROM documents)"""
