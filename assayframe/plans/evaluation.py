"""Scoring over the driver's tables: labels are truth, rules over documents what was produced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import clamped, ratio
from ..operators import scoring, summaries
from . import standins as s
from .registry import Registry

_own = Registry()
query, QUERIES, ORACLES = _own.query, _own.queries, _own.oracles

MATCHED = """m AS (SELECT l.doc_id, CAST(quality AS VARCHAR) AS e_quality, CASE WHEN n_chars > 1200 THEN '1' WHEN n_chars > 300 THEN '0' END AS p_quality,
  CASE WHEN toxic = 1 THEN 'yes' END AS e_toxic, CASE WHEN n_chars % 5 = 0 THEN 'yes' END AS p_toxic, lang AS e_lang, CASE WHEN n_chars % 7 = 0 THEN 'en' ELSE lang END AS p_lang, l.doc_id % 11 = 0 AS unsure, source FROM labels l JOIN documents USING (doc_id))"""


def _matched(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    both = s.read(spark, d, "labels").join(s.read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    return both.select(
        "doc_id", F.col("quality").cast("string").alias("e_quality"), F.when(n > 1200, "1").when(n > 300, "0").alias("p_quality"), F.when(F.col("toxic") == 1, "yes").alias("e_toxic"), F.when(n % 5 == 0, "yes").alias("p_toxic"),
        F.col("lang").alias("e_lang"), F.when(n % 7 == 0, "en").otherwise(F.col("lang")).alias("p_lang"), F.when(F.col("doc_id") % 11 == 0, F.array(F.lit("quality"))).otherwise(F.array().cast("array<string>")).alias("ambiguous"), "source",
    )


@query(f"""WITH {MATCHED}, f AS (SELECT 'quality' AS field, CASE WHEN unsure THEN 'unresolved' WHEN e_quality IS NOT DISTINCT FROM p_quality THEN 'correct' ELSE 'incorrect' END AS st FROM m
  UNION ALL SELECT 'toxic', CASE WHEN e_toxic IS NOT DISTINCT FROM p_toxic THEN 'correct' ELSE 'incorrect' END FROM m UNION ALL SELECT 'lang', CASE WHEN e_lang IS NOT DISTINCT FROM p_lang THEN 'correct' ELSE 'incorrect' END FROM m)
SELECT field, count(CASE st WHEN 'correct' THEN 1 END) AS correct, count(CASE st WHEN 'incorrect' THEN 1 END) AS incorrect, count(CASE st WHEN 'unresolved' THEN 1 END) AS unresolved, count(*) AS denominator FROM f GROUP BY 1""")
def field_confusion(spark: SparkSession, d: str) -> DataFrame:
    return scoring.field_confusion(_matched(spark, d), ["quality", "toxic", "lang"], F.col("ambiguous"))


@query(f"""WITH {MATCHED} SELECT e_lang, count(CASE WHEN p_quality = '0' THEN 1 END) AS q0, count(CASE WHEN p_quality = '1' THEN 1 END) AS q1 FROM m GROUP BY 1""")
def field_confusion_pivot(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d).groupBy("e_lang").pivot("p_quality", ["0", "1"]).count().select("e_lang", F.coalesce("0", F.lit(0)).cast("long").alias("q0"), F.coalesce("1", F.lit(0)).cast("long").alias("q1"))


@query(f"""WITH {MATCHED}, g AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, CASE WHEN doc_id % 13 <> 0 THEN e_lang END AS e, CASE WHEN doc_id % 17 <> 0 THEN source END AS a FROM m)
SELECT count(CASE WHEN ok AND se = sa THEN 1 END) AS correct, count(CASE WHEN ok AND se <> sa THEN 1 END) AS incorrect, count(CASE WHEN NOT ok THEN 1 END) AS unresolved
FROM (SELECT x.e IS NOT NULL AND y.e IS NOT NULL AND x.a IS NOT NULL AND y.a IS NOT NULL AS ok, x.e = y.e AS se, x.a = y.a AS sa FROM g x JOIN g y ON x.i < y.i)""")
def pairwise_agreement(spark: SparkSession, d: str) -> DataFrame:
    m = _matched(spark, d).select(F.when(F.col("doc_id") % 13 != 0, F.col("e_lang")).alias("e"), F.when(F.col("doc_id") % 17 != 0, F.col("source")).alias("a"))
    return scoring.pairwise_agreement(m, "e", "a")


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    item = s.measurements(spark, d).join(s.records(spark, d).select("record_id", "collection_date"), "record_id")
    row = lambda value, page, unit, keep: item.where(keep).select(F.col("record_id").cast("string").alias("report_id"), F.col("measurement_id").alias("idx"), F.col("biomarker_id").alias("label"), page.alias("page"), value.alias("value"), F.col("collection_date").alias("date"), "specimen", unit.alias("unit"))
    line = F.col("line")
    expected = row(F.col("num"), line % 3, F.col("unit"), F.col("measurement_id") % 9 != 0)
    produced = row(F.when(F.col("measurement_id") % 5 != 0, F.col("num")).otherwise(F.col("num") + 1), F.when(F.col("measurement_id") % 7 != 0, line % 3).otherwise(line % 2), F.lit("mg/dL"), F.col("measurement_id") % 8 != 0)
    return expected, produced


@query()
def match_cascade(spark: SparkSession, d: str) -> DataFrame:
    return scoring.match_cascade(*_sides(spark, d))


@query("""WITH e AS (SELECT o_custkey AS a, o_orderstatus AS b, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2), p AS (SELECT o_custkey AS a, o_orderstatus AS b, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2)
SELECT CAST(coalesce(sum(greatest(0, p.n - greatest(1, coalesce(e.n, 0)))), 0) AS BIGINT) AS duplicates, CAST(coalesce(sum(CASE WHEN e.n IS NULL THEN p.n END), 0) AS BIGINT) AS spurious FROM p LEFT JOIN e USING (a, b)""")
def duplicate_spurious_counts(spark: SparkSession, d: str) -> DataFrame:
    o = s.read(spark, d, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderstatus").alias("b"), "o_orderkey")
    return scoring.surplus(o.where("o_orderkey % 3 = 0").drop("o_orderkey"), o.where("o_orderkey % 2 = 0").drop("o_orderkey"), ["a", "b"])


@query(f"""WITH {MATCHED} SELECT source, count(*) AS n, round(count(CASE WHEN e_quality = p_quality THEN 1 END) / count(*), 9) AS recall, round(coalesce(count(CASE WHEN e_quality = p_quality AND p_quality = '0' THEN 1 END) / nullif(count(CASE WHEN p_quality = '0' THEN 1 END), 0), 0), 9) AS precision_low,
  count(DISTINCT e_lang) AS n_languages FROM m GROUP BY 1""")
def quality_ratios(spark: SparkSession, d: str) -> DataFrame:
    same = F.coalesce(F.col("e_quality") == F.col("p_quality"), F.lit(False))
    low = F.col("p_quality") == "0"
    g = _matched(spark, d).groupBy("source").agg(F.count("*").alias("n"), summaries.count_if(same).alias("same"), summaries.count_if(same & low).alias("same_low"), summaries.count_if(low).alias("low"), F.count_distinct("e_lang").alias("n_languages"))
    return g.select("source", "n", F.round(clamped(ratio(F.col("same"), F.col("n")), 0.0, 1.0), 9).alias("recall"), F.round(ratio(F.col("same_low"), F.col("low")), 9).alias("precision_low"), "n_languages")


CODES = ["missing-source", "unknown-role", "unit-mismatch", "value-mismatch"]


@query("WITH c(code) AS (VALUES " + ", ".join(f"('{c}')" for c in CODES) + """), p AS (SELECT CASE WHEN l_quantity > 49 THEN 'missing-source' WHEN l_discount > 0.099 THEN 'unit-mismatch' WHEN l_tax > 0.079 THEN 'value-mismatch' END AS code FROM lineitem)
SELECT c.code, count(p.code) AS n FROM c LEFT JOIN p USING (code) GROUP BY 1""")
def failure_histogram(spark: SparkSession, d: str) -> DataFrame:
    codes = spark.createDataFrame([(c,) for c in CODES], "code string")
    p = s.read(spark, d, "lineitem").select(F.when(F.col("l_quantity") > 49, "missing-source").when(F.col("l_discount") > 0.099, "unit-mismatch").when(F.col("l_tax") > 0.079, "value-mismatch").alias("code"))
    return summaries.zero_filled(codes, p.where("code is not null"), "code")


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity > 49 THEN 'missing-source' WHEN l_discount > 0.099 THEN 'unit-mismatch' END AS code FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, code, NOT bool_or(code IS NOT NULL) OVER (PARTITION BY l_orderkey) AS accepted FROM p""")
def proposal_validation(spark: SparkSession, d: str) -> DataFrame:
    p = s.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    return scoring.validated(p, "l_orderkey", [("missing-source", F.col("l_quantity") > 49), ("unit-mismatch", F.col("l_discount") > 0.099)]).drop("l_quantity", "l_discount")


@query("""WITH r AS (SELECT o_custkey % 50 AS report_id, o_orderstatus AS pipeline_id, o_orderpriority AS version, CASE WHEN o_custkey % 50 < 20 THEN 0 ELSE o_orderkey % 2 END AS sha256, CASE WHEN o_custkey % 50 < 35 THEN 5 ELSE o_orderkey % 3 END AS n_expected FROM orders),
g AS (SELECT report_id, count(DISTINCT sha256) AS h, count(DISTINCT n_expected) AS e FROM r GROUP BY 1)
SELECT report_id, 'hash' AS issue FROM g WHERE h > 1 UNION SELECT report_id, 'expected' FROM g WHERE e > 1 UNION SELECT report_id, 'repeated' FROM r GROUP BY report_id, pipeline_id, version HAVING count(*) > 1""")
def comparison_assertions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_custkey") % 50
    r = s.read(spark, d, "orders").select(k.alias("report_id"), F.col("o_orderstatus").alias("pipeline_id"), F.col("o_orderpriority").alias("version"), F.when(k < 20, 0).otherwise(F.col("o_orderkey") % 2).alias("sha256"), F.when(k < 35, 5).otherwise(F.col("o_orderkey") % 3).alias("n_expected"))
    return scoring.comparison_issues(r)
