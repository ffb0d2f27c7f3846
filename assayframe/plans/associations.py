"""Scores of matched rows, proposals, mappings and confirmation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import associations, summaries
from . import standins as s
from .evaluation import MATCHED, _matched
from .registry import Registry

_own = Registry()
query, QUERIES, ORACLES = _own.query, _own.queries, _own.oracles

_STATUS = "CASE WHEN e_{0} IS NOT DISTINCT FROM p_{0} THEN 'correct' ELSE 'incorrect' END"
_FIELDS = f"""f AS (SELECT *, CASE WHEN unsure THEN 'unresolved' ELSE {_STATUS.format("quality")} END AS q, {_STATUS.format("toxic")} AS t, {_STATUS.format("lang")} AS l FROM m)"""


def _with_status(spark: SparkSession, d: str) -> DataFrame:
    """Matched rows with the status of each field: q, t and l."""
    same = lambda f: F.when(F.col(f"e_{f}").eqNullSafe(F.col(f"p_{f}")), "correct").otherwise("incorrect")
    return _matched(spark, d).withColumns({"q": F.when(F.array_contains("ambiguous", "quality"), "unresolved").otherwise(same("quality")), "t": same("toxic"), "l": same("lang")})


@query(f"""WITH {MATCHED}, {_FIELDS}, g AS (SELECT source,
  CASE WHEN q = 'correct' AND t = 'correct' AND l = 'correct' THEN 'correct' WHEN q = 'unresolved' OR t = 'unresolved' OR l = 'unresolved' THEN 'unresolved' ELSE 'incorrect' END AS critical,
  CASE WHEN q = 'correct' AND l = 'correct' THEN 'correct' WHEN q = 'unresolved' THEN 'unresolved' ELSE 'incorrect' END AS label_value,
  (q = 'incorrect' AND p_quality IS NOT NULL AND e_quality IS NOT NULL) OR (t = 'incorrect' AND e_toxic IS NOT NULL AND p_toxic IS NOT NULL) OR (l = 'incorrect' AND e_lang IS NOT NULL AND p_lang IS NOT NULL) AS wrong FROM f),
c AS (SELECT source, count(*) AS n, count(CASE critical WHEN 'correct' THEN 1 END) AS critical_correct, count(CASE critical WHEN 'incorrect' THEN 1 END) AS critical_incorrect, count(CASE critical WHEN 'unresolved' THEN 1 END) AS critical_unresolved,
  count(CASE label_value WHEN 'correct' THEN 1 END) AS label_value_correct, count(CASE label_value WHEN 'incorrect' THEN 1 END) AS label_value_incorrect, count(CASE label_value WHEN 'unresolved' THEN 1 END) AS label_value_unresolved, count(CASE WHEN wrong THEN 1 END) AS wrong FROM g GROUP BY 1)
SELECT *, greatest(0, n - label_value_correct) AS unrecovered, greatest(0, wrong - label_value_incorrect) AS wrong_other FROM c""")
def association_counts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    kinds = ["correct", "incorrect", "unresolved"]
    outcomes = {"critical": (associations.association([c("q"), c("t"), c("l")]), kinds), "label_value": (associations.association([c("q"), c("l")]), kinds)}
    wrong = associations.contradicts([(c(f"e_{f}"), c(f"p_{f}"), c(f[0])) for f in ("quality", "toxic", "lang")])
    counts = associations.outcome_counts(_with_status(spark, d), ["source"], outcomes, n=F.lit(True), wrong=wrong)
    return counts.withColumns({"unrecovered": associations.shortfall(c("n"), c("label_value_correct")), "wrong_other": associations.shortfall(c("wrong"), c("label_value_incorrect"))})


@query(f"""WITH {MATCHED}, g AS (SELECT source, doc_id % 19 <> 0 AS eg, doc_id % 23 <> 0 AS ag, CASE WHEN doc_id % 5 <> 0 THEN e_lang END AS e, CASE WHEN doc_id % 3 <> 0 THEN p_lang END AS a, CASE WHEN doc_id % 4 <> 0 THEN e_toxic IS NOT NULL END AS et, p_quality = '1' AS av FROM m),
o AS (SELECT source, CASE WHEN NOT (eg AND ag) THEN 'u' WHEN a IS NULL AND e IS NULL THEN 'c' WHEN a IS NULL THEN 's' WHEN e IS NULL OR a <> e THEN 'i' ELSE 'c' END AS mp, CASE WHEN et IS NULL OR av IS NULL THEN 'u' WHEN et = av THEN 'c' ELSE 'i' END AS tr FROM g)
SELECT source, count(CASE mp WHEN 'c' THEN 1 END) AS mapping_correct, count(CASE mp WHEN 'i' THEN 1 END) AS mapping_incorrect, count(CASE mp WHEN 's' THEN 1 END) AS mapping_unsupported, count(CASE mp WHEN 'u' THEN 1 END) AS mapping_unevaluated,
  count(CASE tr WHEN 'c' THEN 1 END) AS trend_correct, count(CASE tr WHEN 'i' THEN 1 END) AS trend_incorrect, count(CASE tr WHEN 'u' THEN 1 END) AS trend_unevaluated FROM o GROUP BY 1""")
def mapping_and_eligibility(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    mapping = associations.mapping_outcome(i % 19 != 0, F.when(i % 5 != 0, F.col("e_lang")), i % 23 != 0, F.when(i % 3 != 0, F.col("p_lang")))
    trend = associations.eligibility_outcome(F.when(i % 4 != 0, F.col("e_toxic").isNotNull()), F.col("p_quality") == "1")
    kinds = ["correct", "incorrect", "unevaluated"]
    return associations.outcome_counts(_matched(spark, d), ["source"], {"mapping": (mapping, [*kinds, "unsupported"]), "trend": (trend, kinds)})


@query("""WITH g AS (SELECT o_orderpriority AS fixture, o_orderkey, list(l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS e, list(l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (l_quantity <= 45) AS p, max(l_returnflag) AS ef, max(CASE WHEN l_quantity <= 45 THEN l_returnflag END) AS pf FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
c AS (SELECT fixture, count(*) AS n, count(CASE WHEN e IS NOT DISTINCT FROM p THEN 1 END) AS n_sources, count(CASE WHEN ef IS NOT DISTINCT FROM pf THEN 1 END) AS n_fields, count(CASE WHEN e IS NOT DISTINCT FROM p AND ef IS NOT DISTINCT FROM pf THEN 1 END) AS n_correct FROM g GROUP BY 1)
SELECT *, round(n_sources / n, 9) AS source_accuracy, round(n_correct / n, 9) AS accuracy FROM c""")
def proposal_correctness(spark: SparkSession, d: str) -> DataFrame:
    """Expected sources of an order are all its lines, proposed ones those of 45 pieces at most; lists are as long as an order."""
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    few = F.col("l_quantity") <= 45
    ids = lambda rows: F.transform(F.sort_array(rows), lambda r: r["l_suppkey"])
    lines = s.read(spark, d, "lineitem").groupBy("l_orderkey").agg(ids(F.collect_list(row)).alias("e"), ids(F.collect_list(F.when(few, row))).alias("p"), F.max("l_returnflag").alias("ef"), F.max(F.when(few, F.col("l_returnflag"))).alias("pf"))
    orders = s.read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("fixture"))
    found = associations.proposal_totals(lines.join(orders, "l_orderkey"), ["fixture"], associations.same_sources(F.col("e"), F.col("p")), F.col("ef").eqNullSafe(F.col("pf")))
    return found.withColumns({c: F.round(c, 9) for c in ("source_accuracy", "accuracy")})


@query(f"""WITH {MATCHED}, {_FIELDS}, u AS (SELECT source, 'quality' AS field, q AS st FROM f UNION ALL SELECT source, 'toxic', t FROM f UNION ALL SELECT source, 'lang', l FROM f)
SELECT source, field, count(CASE st WHEN 'correct' THEN 1 END) AS n_correct, count(*) AS n_expected, round(count(CASE st WHEN 'correct' THEN 1 END) / count(*), 9) AS accuracy FROM u GROUP BY 1, 2""")
def selection_accuracy(spark: SparkSession, d: str) -> DataFrame:
    right = {"quality": F.col("q") == "correct", "toxic": F.col("t") == "correct", "lang": F.col("l") == "correct"}
    return associations.selection_accuracy(_with_status(spark, d), ["source"], right).withColumn("accuracy", F.round("accuracy", 9))


@query(f"""WITH {MATCHED}, c AS (SELECT source, count(CASE WHEN p_quality IS NOT NULL THEN 1 END) AS n_supported, count(CASE WHEN p_quality = e_quality THEN 1 END) AS n_mapped, count(CASE WHEN p_quality IS NULL THEN 1 END) AS n_unsupported, count(CASE WHEN p_quality IS NULL AND e_lang IS NOT DISTINCT FROM p_lang THEN 1 END) AS n_preserved FROM m GROUP BY 1)
SELECT *, CASE WHEN n_supported = 0 THEN 0 ELSE round(n_mapped / n_supported, 9) END AS mapping_accuracy, CASE WHEN n_unsupported = 0 THEN 0 ELSE round(n_preserved / n_unsupported, 9) END AS preservation_accuracy FROM c""")
def support_split(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    found = associations.support_split(_matched(spark, d), ["source"], c("p_quality").isNotNull(), c("p_quality").eqNullSafe(c("e_quality")), c("e_lang").eqNullSafe(c("p_lang")))
    return found.withColumns({x: F.round(x, 9) for x in ("mapping_accuracy", "preservation_accuracy")})


@query("""WITH a AS (SELECT lower(p_brand) || ' ' || p_size AS alias, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1), b AS (SELECT DISTINCT lower(p_brand) || ' ' || (p_size + 7) AS alias FROM part WHERE p_size % 10 = 0),
l AS (SELECT CASE WHEN l_linenumber = 7 THEN '' ELSE lower(p_brand) || ' ' || (p_size + 1) END AS label FROM lineitem JOIN part ON p_partkey = l_partkey),
r AS (SELECT CASE WHEN label = '' THEN 'empty-label' WHEN b.alias IS NOT NULL THEN 'unsafe-alias' WHEN a.n IS NULL THEN 'no-exact-reviewed-alias' WHEN a.n > 1 THEN 'ambiguous-exact-alias' ELSE 'exact-reviewed-alias' END AS reason FROM l LEFT JOIN a ON a.alias = label LEFT JOIN b ON b.alias = label)
SELECT reason, count(r.reason) AS n FROM (VALUES ('empty-label'), ('unsafe-alias'), ('no-exact-reviewed-alias'), ('ambiguous-exact-alias'), ('exact-reviewed-alias')) c(reason) LEFT JOIN r USING (reason) GROUP BY 1""")
def annotation_reasons(spark: SparkSession, d: str) -> DataFrame:
    part = s.read(spark, d, "part")
    said = lambda more: F.concat_ws(" ", F.lower("p_brand"), (F.col("p_size") + more).cast("string"))
    aliases, unsafe = part.select(said(0).alias("alias"), F.col("p_partkey").alias("entry_id")), part.where("p_size % 10 = 0").select(said(7).alias("alias"))
    item = s.read(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_linenumber")
    labels = item.join(part, "p_partkey").select(F.when(F.col("l_linenumber") == 7, "").otherwise(said(1)).alias("label"))
    reasons = spark.createDataFrame([(r,) for r in associations.MAPPING_REASONS], "reason string")
    return summaries.zero_filled(reasons, associations.mapping_reasons(labels, aliases, unsafe).select("reason"), "reason")


@query("""WITH c AS (SELECT l_orderkey, count(CASE WHEN l_returnflag <> 'R' THEN 1 END) AS included, count(CASE WHEN l_returnflag <> 'R' AND l_tax > 0.06 THEN 1 END) AS needs_review FROM lineitem GROUP BY 1)
SELECT *, included > 0 AND needs_review = 0 AS can_confirm, CASE WHEN needs_review > 0 THEN 'rows-need-resolution' WHEN included = 0 THEN 'no-included-rows' END AS blocked_reason FROM c""")
def confirmation_gate(spark: SparkSession, d: str) -> DataFrame:
    decision = F.when(F.col("l_returnflag") == "R", "skip").otherwise("resolve")
    return associations.confirmation_gate(s.read(spark, d, "lineitem"), ["l_orderkey"], decision, F.col("l_tax") > 0.06)
