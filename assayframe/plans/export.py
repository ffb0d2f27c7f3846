"""Exports, layout and catalogue checks over the driver's tables: documents' lines are pages of positioned text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogue, layout
from ..sources import readers, sinks
from . import standins as s
from .registry import Registry
from .standins import LINES

_own = Registry()
query, QUERIES, ORACLES = _own.query, _own.queries, _own.oracles


def _observations(spark: SparkSession, d: str) -> DataFrame:
    """Supplier and part cells as a page of text: three columns per line, with a little noise in their places."""
    item = s.read(spark, d, "lineitem")
    noise = (F.col("l_partkey") % 7) / 2000.0
    y = F.row_number().over(_by_line()) * 0.03
    row = item.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (y + noise).alias("y"), "l_quantity")
    cells = F.array(
        F.struct(F.lit("a").alias("c"), F.lit(0.1).alias("x"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("text")),
        F.struct(F.lit("b").alias("c"), F.lit(0.4).alias("x"), F.col("l_quantity").cast("int").cast("string").alias("text")),
        F.struct(F.lit("c").alias("c"), F.lit(0.6).alias("x"), F.lit("mg/dL").alias("text")),
    )
    return row.select(
        F.col("l_orderkey").cast("string").alias("report_id"), F.lit(0).alias("page_index"), F.explode(cells).alias("k"), "l_linenumber", "l_partkey", "l_suppkey", "y",
    ).select("report_id", "page_index", F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", "k.c").alias("observation_id"), "k.text", "k.x", "y", F.lit(0.1).alias("width"), F.lit(0.012).alias("height"))


def _by_line():
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS report_id, n AS line, 'Part ' || l_partkey AS label, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS value, 'mg/dL' AS unit
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem)""")
def report_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = layout.row_candidates(layout.roles(layout.lattice(_observations(spark, d))))
    return rows.select("report_id", F.col("line").cast("long").alias("line"), "label", "value", "unit")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS report_id, string_agg('Part ' || l_partkey || ' ' || CAST(l_quantity AS INTEGER) || ' mg/dL', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) AS text FROM lineitem GROUP BY 1""")
def line_reading_order(spark: SparkSession, d: str) -> DataFrame:
    return layout.page_text(layout.lattice(_observations(spark, d))).select("report_id", "text")


@query("""SELECT n_nationkey, '"' || n_name || '","' || n_regionkey || '"' AS value FROM nation""")
def csv_sink(spark: SparkSession, d: str) -> DataFrame:
    nation = s.read(spark, d, "nation")
    return nation.select("n_nationkey", sinks.csv_line([nation["n_name"], nation["n_regionkey"]]).alias("value"))


@query("""SELECT 'nation' AS name, count(*) AS n_rows, CAST(sum(strlen('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') + 1) AS BIGINT) AS n_bytes FROM nation""")
def export_manifest(spark: SparkSession, d: str) -> DataFrame:
    return sinks.manifest({"nation": sinks.json_lines(s.read(spark, d, "nation"))}).select("name", "n_rows", "n_bytes")


@query("""SELECT event_id, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k FROM events WHERE event_id % 3 <> 0""")
def truncated_json(spark: SparkSession, d: str) -> DataFrame:
    cut = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("["), F.substring("props", 1, 4))).otherwise(F.concat(F.lit("["), F.col("props"), F.lit(', {"k": 1')))
    rows = readers.truncated_array(s.events(spark, d).select("event_id", cut.alias("t")), "t", "k bigint")
    return rows.select("event_id", F.explode("items").alias("i")).select("event_id", "i.k")


@query("""WITH e AS (SELECT DISTINCT p_brand AS id FROM part WHERE p_brand NOT LIKE '%5'), a AS (SELECT DISTINCT p_brand AS id, lower(split_part(p_name, ' ', 1)) AS alias FROM part)
SELECT 'alias-collision' AS issue, alias AS subject FROM a GROUP BY 2 HAVING count(DISTINCT id) > 1 UNION SELECT 'alias-of-unknown', alias FROM a WHERE id LIKE '%5'
UNION SELECT 'wording', alias FROM a WHERE regexp_matches(alias, 'hot|small') UNION SELECT 'conversion-unit', id || ':mmol/L:g/L' FROM e WHERE id LIKE '%2'""")
def catalogue_release_issues(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue of brands that has every kind of fault."""
    entries = s.entries(spark, d)
    aliases = s.read(spark, d, "part").select(F.col("p_brand").alias("biomarker_id"), F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("alias_norm")).distinct()
    conversions = entries.where(F.col("biomarker_id").endswith("2")).select("biomarker_id", F.lit("mmol/L").alias("from_unit"), F.lit("g/L").alias("to_unit"))
    return catalogue.release_issues(entries, aliases, conversions, ["hot|small"])


@query(f"""WITH {LINES} SELECT doc_id, count(*) AS n_lines, count(CASE WHEN length(text) <= 96 AND regexp_matches(text, '[a-zA-Z]') THEN 1 END) AS n_short FROM lines GROUP BY 1""")
def line_counts(spark: SparkSession, d: str) -> DataFrame:
    short = (F.length("text") <= 96) & F.col("text").rlike("[a-zA-Z]")
    return s.lines(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count(F.when(short, 1)).alias("n_short"))


@query("""SELECT s_suppkey, unnest(range(0, greatest(1, CAST(ceil((s_suppkey + 100 - 200) / 150.0) AS BIGINT) + 1))) * 150 AS top FROM supplier""")
def page_bands(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.geometry import overlapping_bands

    bands = s.read(spark, d, "supplier").select("s_suppkey", F.explode(overlapping_bands(F.col("s_suppkey") + 100, 200, 150)).alias("b"))
    return bands.select("s_suppkey", F.col("b.top").cast("long").alias("top"))


@query("""SELECT s_suppkey, unnest(list_transform(range(0, greatest(1, CAST(ceil((s_suppkey + 100 - 200) / 150.0) AS BIGINT) + 1)), lambda i: least(i * 150, greatest(0, s_suppkey + 100 - 200)))) AS top FROM supplier""")
def page_bands_of_equal_height(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.geometry import overlapping_bands

    bands = s.read(spark, d, "supplier").select("s_suppkey", F.explode(overlapping_bands(F.col("s_suppkey") + 100, 200, 150, keep_height=True)).alias("b"))
    return bands.select("s_suppkey", F.col("b.top").cast("long").alias("top"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'cold|hot') THEN 'cold|hot' WHEN regexp_matches(p_name, 'wid') THEN 'wid' END AS wording FROM part""")
def forbidden_words(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import forbidden_wording

    return s.read(spark, d, "part").select("p_partkey", forbidden_wording(F.col("p_name"), ["cold|hot", "wid"]).alias("wording"))


@query("""SELECT user_id, CASE WHEN max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 1 THEN 'laboratory-table' WHEN max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) = 1 THEN 'imaging-narrative' ELSE 'unknown' END AS page_class FROM events GROUP BY 1""")
def page_classes(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("event_type") == "error", "Result mg/dL").when(F.col("event_type") == "view", "Findings: MRI").otherwise("note")
    pages = s.events(spark, d).select(F.col("user_id").alias("report_id"), F.lit(0).alias("page_index"), said.alias("text"))
    return layout.page_class(pages).select(F.col("report_id").alias("user_id"), "page_class")


@query("""WITH r AS (SELECT l_orderkey AS report_id, l_suppkey % 3 AS table_id, CASE WHEN l_linenumber % 4 = 0 THEN 'urine' END AS own FROM lineitem),
h AS (SELECT o_orderkey AS report_id, o_custkey % 3 AS table_id, CASE o_orderstatus WHEN 'F' THEN 'serum' WHEN 'O' THEN 'blood' ELSE 'unknown' END AS specimen FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(own, t.specimen, u.specimen, 'unknown') AS specimen, count(*) AS n FROM r LEFT JOIN (SELECT * FROM h WHERE specimen <> 'unknown') t USING (report_id, table_id) LEFT JOIN (SELECT report_id, specimen FROM h WHERE specimen <> 'unknown') u USING (report_id) GROUP BY 1""")
def specimen_contexts(spark: SparkSession, d: str) -> DataFrame:
    rows = s.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("report_id"), (F.col("l_suppkey") % 3).alias("table_id"), F.when(F.col("l_linenumber") % 4 == 0, "urine").alias("own"))
    said = F.when(F.col("o_orderstatus") == "F", "serum").when(F.col("o_orderstatus") == "O", "blood").otherwise("unknown")
    headings = s.read(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("report_id"), (F.col("o_custkey") % 3).alias("table_id"), said.alias("specimen"))
    return layout.specimen_of_rows(rows, headings).groupBy("specimen").agg(F.count("*").alias("n"))


@query("""SELECT n_regionkey, strlen('[{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}]') > 42 AS rejected, count(*) AS n_rows FROM nation GROUP BY 1, 2""")
def bounded_json(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 42 bytes hold one nation; one with a long name is rejected, not left out."""
    nation = s.read(spark, d, "nation")
    chunks = layout.bounded_chunks(nation, ["n_regionkey"], "n_nationkey", F.to_json(F.struct("n_nationkey", "n_name")), 42)
    rows = F.size(F.from_json("json", "array<struct<n_nationkey:int>>"))
    return chunks.where("n_bytes <= 42 or rejected").groupBy("n_regionkey", "rejected").agg(F.sum(rows).cast("long").alias("n_rows"))

