"""Readers with a fixed schema; what does not fit is set aside, not guessed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES, check_schema


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A Parquet table of the data model; fails on unknown or missing columns."""
    return check_schema(spark.read.parquet(path), name)


def snapshot(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """Several tables of one immutable snapshot folder."""
    return {n: table(spark, f"{root}/{n}.parquet", n) for n in names}


def json_rows(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) rows of JSON lines: a line that isn't JSON of the schema is kept as text in the second."""
    raw = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names
    lines = spark.read.text(path)
    parsed = lines.select(F.from_json("value", raw.schema, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"), "value")
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    return parsed.where(~bad).select(*[F.col(f"r.{n}").alias(n) for n in names]), parsed.where(bad).select("value")


def truncated_array(rows: DataFrame, text_col: str, schema: str) -> DataFrame:
    """rows with `items`: the complete objects of a JSON array that may break off, whatever is nested or quoted in them."""
    from ..operators.recovery import complete_objects

    parsed = F.transform(complete_objects(F.col(text_col)), lambda o: F.from_json(o, schema))
    return rows.withColumn("items", F.filter(parsed, lambda r: r.isNotNull()))


def word_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(page, x_min, y_min, x_max, y_max, text) of a bounding-box XML of pages and words."""
    schema = "_width double, _height double, word array<struct<_xMin:double,_yMin:double,_xMax:double,_yMax:double,_VALUE:string>>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    numbered = pages.withColumn("page", F.monotonically_increasing_id())
    return numbered.select("page", F.explode("word").alias("w")).select("page", F.col("w._xMin").alias("x_min"), F.col("w._yMin").alias("y_min"), F.col("w._xMax").alias("x_max"), F.col("w._yMax").alias("y_max"), F.col("w._VALUE").alias("text"))


def bound_to(artifacts: DataFrame, expected: DataFrame, key: str, digest: str) -> DataFrame:
    """Artifacts whose digest is the expected one for their key; anything else is not reused."""
    return artifacts.join(expected.select(key, digest), [key, digest], "left_semi")


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])
