"""Histories, summaries and catalogue lookups over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import catalogue, scans, summaries, trends
from . import standins as s
from .registry import Registry
from .standins import ENTRIES, MEASUREMENTS, NORMALIZED, RECORDS

_own = Registry()
query, QUERIES, ORACLES = _own.query, _own.queries, _own.oracles


@query(f"""WITH {MEASUREMENTS}, {ENTRIES}
SELECT record_id, count(*) AS n_results, count(CASE WHEN flag = 'R' THEN 1 END) AS n_flagged,
       count(CASE WHEN c THEN 1 END) AS n_comparable, count(CASE WHEN NOT c THEN 1 END) AS n_preserved
FROM (SELECT m.*, coalesce(kind = 'numeric' AND review_state = 'confirmed' AND unit IN ('mg/dL', 'mmol/L') AND e.biomarker_id IS NOT NULL, FALSE) AS c
      FROM measurements m LEFT JOIN entries e USING (biomarker_id)) GROUP BY record_id""")
def record_summary(spark: SparkSession, d: str) -> DataFrame:
    return summaries.record_summary(_judged(spark, d), "record_id", F.col("flag") == "R", F.col("reason").isNull())


def _judged(spark: SparkSession, d: str) -> DataFrame:
    known = s.measurements(spark, d).join(s.entries(spark, d), "biomarker_id", "left")
    reason = trends.support_reason(F.col("units").isNotNull(), F.array_contains("units", F.col("unit")), F.lit(True), F.lit(True))
    return known.withColumn("reason", reason)


@query(f"""WITH {MEASUREMENTS}, {ENTRIES}
SELECT coalesce(reason, 'comparable') AS reason, count(*) AS n FROM (
  SELECT CASE WHEN m.biomarker_id IS NULL THEN 'unmapped' WHEN e.biomarker_id IS NULL THEN 'unsupported-canonical-id' WHEN kind <> 'numeric' THEN 'non-numeric-value'
              WHEN review_state <> 'confirmed' THEN 'unconfirmed' WHEN unit IS NULL THEN 'missing-unit' WHEN unit NOT IN ('mg/dL', 'mmol/L') THEN 'incompatible-unit' END AS reason
  FROM measurements m LEFT JOIN entries e USING (biomarker_id)) GROUP BY 1""")
def comparability_reason(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).groupBy(F.coalesce("reason", F.lit("comparable")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {MEASUREMENTS}, {ENTRIES}
SELECT measurement_id, unit, {NORMALIZED} AS normalized FROM measurements JOIN entries USING (biomarker_id) WHERE {NORMALIZED} IS NOT NULL""")
def unit_conversion(spark: SparkSession, d: str) -> DataFrame:
    found = trends.normalized(s.measurements(spark, d), s.entries(spark, d), s.conversions(spark, d))
    return found.where("normalized is not null").select("measurement_id", "unit", "normalized")


def _history(spark: SparkSession, d: str) -> DataFrame:
    entries = s.entries(spark, d)
    records = s.records(spark, d)
    measured = trends.normalized(s.measurements(spark, d).where("biomarker_id is not null"), entries, s.conversions(spark, d)).join(records, "record_id")
    two = F.coalesce("two_groups", F.lit(False))
    flagged = (
        measured.withColumn("entry_known", F.col("units").isNotNull())
        .withColumn("unit_known", F.coalesce(F.array_contains("units", F.col("unit")), F.lit(False)))
        .withColumn("specimen_ok", ~two | (F.col("specimen") == F.col("record_specimen")))
        .withColumn("method_ok", F.lit(True))
        .withColumn("needs_profile", F.lit(False))
        .withColumn("profile_id", F.lit(None).cast("string"))
        .withColumn("group_index", F.when(F.col("units").isNotNull(), F.when(two & (F.col("specimen") == "serum"), 1).otherwise(0)))
    )
    known = flagged.select("subject_id", "biomarker_id", "record_id", "record_ordinal", "collection_date", "measurement_id", "measurement_ordinal", "kind", "review_state", "unit", "entry_known", "unit_known", "specimen_ok", "method_ok", "needs_profile", "profile_id", "group_index", "normalized")
    return trends.history(trends.with_absent(records, known, entries))


# The history in SQL: rows (measured and absent), the identity of the first eligible row, points, and the number of breaks so far.
HISTORY = f"""{RECORDS}, {MEASUREMENTS}, {ENTRIES},
measured AS (
  SELECT r.subject_id, m.biomarker_id, m.record_id, r.record_ordinal, r.collection_date, m.measurement_id, m.measurement_ordinal, kind, review_state, unit,
         e.biomarker_id IS NOT NULL AS entry_known, (NOT coalesce(two_groups, FALSE) OR specimen = record_specimen) AS specimen_ok,
         CASE WHEN e.biomarker_id IS NOT NULL THEN CASE WHEN two_groups AND specimen = 'serum' THEN 1 ELSE 0 END END AS group_index,
         CASE WHEN e.biomarker_id IS NOT NULL THEN {NORMALIZED} END AS normalized
  FROM measurements m JOIN records r USING (record_id) LEFT JOIN entries e ON m.biomarker_id = e.biomarker_id WHERE m.biomarker_id IS NOT NULL),
wanted AS (SELECT DISTINCT subject_id, biomarker_id FROM measured WHERE entry_known),
every AS (
  SELECT * FROM measured UNION ALL
  SELECT r.subject_id, w.biomarker_id, r.record_id, r.record_ordinal, r.collection_date, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
  FROM records r JOIN wanted w USING (subject_id) WHERE NOT EXISTS (SELECT 1 FROM measured m WHERE m.record_id = r.record_id AND m.biomarker_id = w.biomarker_id)),
eligible AS (
  SELECT *, coalesce(measurement_id IS NOT NULL AND entry_known AND collection_date IS NOT NULL AND review_state = 'confirmed' AND kind = 'numeric'
                     AND specimen_ok AND normalized IS NOT NULL, FALSE) AS ok,
         row_number() OVER (PARTITION BY subject_id, biomarker_id ORDER BY collection_date ASC NULLS LAST, record_ordinal, measurement_ordinal ASC NULLS FIRST) AS pos FROM every),
identity AS (SELECT subject_id, biomarker_id, arg_min(group_index, pos) AS active FROM eligible WHERE ok GROUP BY 1, 2),
judged AS (
  SELECT e.*, i.active, coalesce(ok AND group_index = active, FALSE) AS is_point,
         CASE WHEN coalesce(ok AND group_index = active, FALSE) THEN NULL WHEN collection_date IS NULL THEN 'date-missing' WHEN measurement_id IS NULL THEN 'not-measured'
              WHEN kind = 'bounded' THEN 'bounded' WHEN NOT entry_known THEN 'unsupported' ELSE 'incompatible' END AS non_point,
         CASE WHEN ok AND NOT coalesce(group_index = active, FALSE) THEN 'incompatible-specimen' WHEN review_state <> 'confirmed' THEN 'unconfirmed'
              WHEN kind <> 'numeric' THEN 'non-numeric-value' WHEN unit IS NULL THEN 'missing-unit' WHEN unit NOT IN ('mg/dL', 'mmol/L') THEN 'incompatible-unit'
              WHEN NOT specimen_ok THEN 'incompatible-specimen' ELSE 'non-numeric-value' END AS why
  FROM eligible e LEFT JOIN identity i USING (subject_id, biomarker_id)),
breaks AS (SELECT *, sum(CASE WHEN is_point THEN 0 ELSE 1 END) OVER (PARTITION BY subject_id, biomarker_id ORDER BY pos) AS island FROM judged),
points AS (SELECT *, dense_rank() OVER (PARTITION BY subject_id, biomarker_id ORDER BY island) AS segment FROM breaks WHERE is_point)"""


@query(f"WITH {HISTORY} SELECT subject_id, biomarker_id, measurement_id, CAST(collection_date AS VARCHAR) AS collection_date, round(normalized, 6) AS normalized, segment FROM points")
def trend_points(spark: SparkSession, d: str) -> DataFrame:
    return trends.points(_history(spark, d)).select("subject_id", "biomarker_id", "measurement_id", F.col("collection_date").cast("string").alias("collection_date"), F.round("normalized", 6).alias("normalized"), F.col("segment").cast("long").alias("segment"))


@query(f"""WITH {HISTORY} SELECT subject_id, biomarker_id, record_id, measurement_id, non_point,
  CASE non_point WHEN 'incompatible' THEN why WHEN 'unsupported' THEN 'unsupported-canonical-id' END AS reason FROM judged WHERE NOT is_point""")
def trend_non_points(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d).where("not is_point").select("subject_id", "biomarker_id", "record_id", "measurement_id", "non_point", "reason")


@query(f"""WITH {HISTORY} SELECT subject_id, biomarker_id, segment, count(*) AS n_points, round(arg_min(normalized, pos), 6) AS first_value, round(arg_max(normalized, pos), 6) AS last_value
FROM points GROUP BY ALL""")
def trend_segments(spark: SparkSession, d: str) -> DataFrame:
    out = trends.segments(trends.points(_history(spark, d)))
    return out.select("subject_id", "biomarker_id", F.col("segment").cast("long").alias("segment"), "n_points", F.round("first_value", 6).alias("first_value"), F.round("last_value", 6).alias("last_value"))


@query(f"""WITH {HISTORY} SELECT subject_id, biomarker_id, measurement_id, next_id FROM (
  SELECT *, lead(measurement_id) OVER (PARTITION BY subject_id, biomarker_id, segment ORDER BY pos) AS next_id FROM points) WHERE next_id IS NOT NULL""")
def segment_connections(spark: SparkSession, d: str) -> DataFrame:
    return trends.connections(trends.points(_history(spark, d))).select("subject_id", "biomarker_id", "measurement_id", "next_id")


@query(f"""WITH {HISTORY}, ends AS (SELECT subject_id, biomarker_id, count(*) AS n_points, arg_min(normalized, pos) AS a, arg_max(normalized, pos) AS b FROM points GROUP BY 1, 2)
SELECT subject_id, biomarker_id, n_points, CASE WHEN n_points < 2 THEN 'not-comparable' WHEN b > a THEN 'increased' WHEN b < a THEN 'decreased' ELSE 'stable' END AS direction FROM ends""")
def trend_direction(spark: SparkSession, d: str) -> DataFrame:
    return trends.directions(trends.points(_history(spark, d))).select("subject_id", "biomarker_id", "n_points", "direction")


LATEST = f"""{HISTORY}, changes AS (
  SELECT subject_id, biomarker_id, CAST(collection_date AS VARCHAR) AS latest_date, previous_value, normalized AS latest_value,
         CASE WHEN normalized > previous_value THEN 'increased' WHEN normalized < previous_value THEN 'decreased' ELSE 'stable' END AS direction
  FROM (SELECT *, lag(normalized) OVER (PARTITION BY subject_id, biomarker_id ORDER BY pos) AS previous_value,
               row_number() OVER (PARTITION BY subject_id, biomarker_id ORDER BY pos DESC) AS n FROM points) WHERE n = 1 AND previous_value IS NOT NULL)"""


@query(f"""WITH {LATEST} SELECT subject_id, biomarker_id, latest_date, round(previous_value, 6) AS previous_value, round(latest_value, 6) AS latest_value, direction, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY latest_date DESC, biomarker_id) AS rank FROM changes) WHERE rank <= 4""")
def trend_latest_change(spark: SparkSession, d: str) -> DataFrame:
    top = trends.top_changes(trends.latest_changes(trends.points(_history(spark, d))), "biomarker_id", 4)
    return top.select("subject_id", "biomarker_id", F.col("latest_date").cast("string").alias("latest_date"), F.round("previous_value", 6).alias("previous_value"), F.round("latest_value", 6).alias("latest_value"), "direction", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {HISTORY} SELECT biomarker_id, count(*) AS n_records, count(CASE WHEN measurement_id IS NULL THEN 1 END) AS n_not_measured FROM every GROUP BY 1""")
def records_cross_biomarker(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d).groupBy("biomarker_id").agg(F.count("*").alias("n_records"), summaries.count_if(F.col("measurement_id").isNull()).alias("n_not_measured"))


@query("""SELECT c_custkey, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS latest_date, coalesce(CAST(sum(CASE WHEN o_orderkey IS NOT NULL THEN 1 END) AS BIGINT), 0) AS n_results
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def report_summary_left(spark: SparkSession, d: str) -> DataFrame:
    orders = s.read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.to_date("o_orderdate").alias("date"), F.lit(1).cast("long").alias("one"))
    return summaries.parent_summary(s.read(spark, d, "customer").select("c_custkey"), orders, "c_custkey", "date", "one").select("c_custkey", F.col("latest_date").cast("string").alias("latest_date"), "n_results")


@query(f"""WITH {MEASUREMENTS} SELECT biomarker_id, count(*) AS n_results, arg_max(unit, measurement_id) AS label FROM measurements
WHERE review_state = 'confirmed' AND biomarker_id IS NOT NULL AND unit IS NOT NULL GROUP BY 1""")
def history_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = s.measurements(spark, d).where("review_state = 'confirmed' and biomarker_id is not null and unit is not null")
    return summaries.entries_with_label(rows, "biomarker_id", "unit", ["measurement_id"])


@query(f"""WITH {RECORDS}, {MEASUREMENTS} SELECT subject_id, coalesce(CAST(collection_date AS VARCHAR), 'missing') AS date, specimen, min(measurement_id) AS first_row,
  count(*) AS n_rows, count(CASE WHEN review_state = 'needs-review' THEN 1 END) AS n_blocking, count(CASE WHEN review_state = 'needs-review' THEN 1 END) = 0 AS can_confirm
FROM measurements JOIN records USING (record_id) GROUP BY 1, 2, 3""")
def confirmation_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = s.measurements(spark, d).join(s.records(spark, d), "record_id")
    keys = {"subject_id": F.col("subject_id"), "date": F.coalesce(F.col("collection_date").cast("string"), F.lit("missing")), "specimen": F.col("specimen")}
    return summaries.confirmation_groups(rows, keys, F.col("measurement_id"), F.col("review_state") == "needs-review")


@query(f"""WITH {RECORDS}, {MEASUREMENTS}, panels AS (
  SELECT subject_id, coalesce(CAST(collection_date AS VARCHAR), 'missing') AS date, specimen, panel, min(measurement_id) AS first_row, count(*) AS n_rows, bool_or(unit IS NULL) AS defaulted
  FROM measurements JOIN records USING (record_id) GROUP BY 1, 2, 3, 4)
SELECT subject_id, date, specimen, count(*) AS n_panels, CAST(sum(n_rows) AS BIGINT) AS n_rows, arg_min(panel, first_row) AS first_panel, bool_or(defaulted) AS defaulted FROM panels GROUP BY 1, 2, 3""")
def panel_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = s.measurements(spark, d).join(s.records(spark, d), "record_id").withColumn("date", F.coalesce(F.col("collection_date").cast("string"), F.lit("missing")))
    panels = rows.groupBy("subject_id", "date", "specimen", "panel").agg(F.min("measurement_id").alias("first_row"), F.count("*").alias("n_rows"), F.bool_or(F.col("unit").isNull()).alias("defaulted"))
    return panels.groupBy("subject_id", "date", "specimen").agg(F.count("*").alias("n_panels"), F.sum("n_rows").alias("n_rows"), F.min_by("panel", "first_row").alias("first_panel"), F.bool_or("defaulted").alias("defaulted"))


@query(f"""WITH {RECORDS}, {MEASUREMENTS} SELECT (SELECT count(*) FROM records) AS n_records, count(*) AS n_total, count(CASE WHEN review_state = 'confirmed' THEN 1 END) AS n_confirmed,
  count(CASE WHEN review_state = 'needs-review' THEN 1 END) AS n_needs_review, count(DISTINCT biomarker_id) AS n_biomarkers FROM measurements""")
def home_totals(spark: SparkSession, d: str) -> DataFrame:
    found = s.measurements(spark, d).agg(F.count("*").alias("n_total"), summaries.count_if(F.col("review_state") == "confirmed").alias("n_confirmed"), summaries.count_if(F.col("review_state") == "needs-review").alias("n_needs_review"), F.count_distinct("biomarker_id").alias("n_biomarkers"))
    return s.records(spark, d).agg(F.count("*").alias("n_records")).crossJoin(found)  # two single rows


@query(f"""WITH {RECORDS} SELECT record_id, subject_id, coalesce(CAST(collection_date AS VARCHAR), '') AS date FROM records ORDER BY date DESC, record_id DESC LIMIT 3""")
def recent_records(spark: SparkSession, d: str) -> DataFrame:
    return s.records(spark, d).select("record_id", "subject_id", F.coalesce(F.col("collection_date").cast("string"), F.lit("")).alias("date")).orderBy(F.desc("date"), F.desc("record_id")).limit(3)


@query(f"""WITH {MEASUREMENTS}, sized AS (SELECT record_id, measurement_id, line FROM measurements WHERE review_state = 'needs-review')
SELECT record_id, arg_min(measurement_id, (line - 3 + 7) % 7 * 100000000000000000 + measurement_id) AS next_blocking FROM sized GROUP BY 1""")
def next_blocking_row(spark: SparkSession, d: str) -> DataFrame:
    rows = s.measurements(spark, d).where("review_state = 'needs-review'")
    return rows.groupBy("record_id").agg(F.min_by("measurement_id", F.struct((F.col("line") - 3 + 7) % 7, "measurement_id")).alias("next_blocking"))


@query("""WITH t AS (SELECT event_id AS id, 'event' AS kind, CASE WHEN event_id % 7 <> 0 THEN CAST(CAST(ts AS DATE) AS VARCHAR) END AS date FROM events
  UNION ALL SELECT o_orderkey, 'record', CAST(CAST(o_orderdate AS DATE) AS VARCHAR) FROM orders)
SELECT id, kind, date, row_number() OVER (ORDER BY date ASC NULLS LAST, kind, id) AS position FROM t""")
def timeline_merge(spark: SparkSession, d: str) -> DataFrame:
    day = lambda c: F.to_date(c).cast("string")
    events = s.events(spark, d).select(F.col("event_id").alias("id"), F.lit("event").alias("kind"), F.when(F.col("event_id") % 7 != 0, day("ts")).alias("date"))
    orders = s.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("record").alias("kind"), day("o_orderdate").alias("date"))
    return scans.numbered(events.unionByName(orders), [F.asc_nulls_last("date"), F.asc("kind"), F.asc("id")])


@query("""WITH alias AS (SELECT DISTINCT p_brand AS entry_id, split_part(p_name, ' ', 1) AS word FROM part), one AS (SELECT word, min(entry_id) AS entry_id FROM alias GROUP BY word HAVING count(DISTINCT entry_id) = 1)
SELECT p_partkey, one.entry_id FROM part LEFT JOIN one ON split_part(p_name, ' ', 1) = one.word""")
def alias_unique_lookup(spark: SparkSession, d: str) -> DataFrame:
    part = s.read(spark, d, "part").withColumn("word", F.split_part("p_name", F.lit(" "), F.lit(1)))
    return catalogue.unique_alias(part.select("p_partkey", "word"), part.select(F.col("p_brand").alias("entry_id"), "word").distinct(), "word").select("p_partkey", "entry_id")


@query("""WITH f AS (SELECT split_part(p_name, ' ', 1) AS word, arg_min(p_brand, p_partkey) AS entry_id FROM part GROUP BY 1)
SELECT p_partkey, f.entry_id FROM part LEFT JOIN f ON split_part(p_name, ' ', 1) = f.word""")
def alias_first_lookup(spark: SparkSession, d: str) -> DataFrame:
    part = s.read(spark, d, "part").withColumn("word", F.split_part("p_name", F.lit(" "), F.lit(1)))
    return catalogue.first_alias(part.select("p_partkey", "word"), part.select(F.col("p_brand").alias("entry_id"), F.col("p_partkey").alias("ordinal"), "word"), "word").select("p_partkey", "entry_id")


ALIASES = [("article", "the"), ("preposition", "of"), ("pair", "of the"), ("verb", "is"), ("french", "de la"), ("german", "und")]


@query(
    "WITH alias(entry_id, alias) AS (VALUES "
    + ", ".join(f"('{e}', '{a}')" for e, a in ALIASES)
    + """), t AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS body FROM documents),
met AS (SELECT doc_id, entry_id, alias, strpos(body, ' ' || alias || ' ') AS pos, body FROM t, alias WHERE strpos(body, ' ' || alias || ' ') > 0)
SELECT doc_id AS id, entry_id, alias, CAST(len(body[1:pos]) - len(replace(body[1:pos], ' ', '')) - 1 AS BIGINT) AS start FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, len(alias) DESC, entry_id) AS n FROM met) WHERE n = 1"""
)
def alias_in_text(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.aliases_in_text(s.read(spark, d, "documents"), spark.createDataFrame(ALIASES, "entry_id string, alias string"), "doc_id", "text")


GUIDANCE = [("Brand#11", "g1", "adult", "EU", "all", "any", None, None), ("Brand#11", "g2", "adult", "EU", "male", "fasting", None, "serum"), ("Brand#12", "g3", "adult", "US", "all", "fasting", "screening", None), ("Brand#13", "g4", "child", "EU", "all", "any", None, None)]


@query(
    "WITH g(biomarker_id, guidance_id, population, jurisdiction, sex, fasting, purpose, specimen) AS (VALUES "
    + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in r) + ")" for r in GUIDANCE)
    + """), c AS (SELECT p_partkey, p_brand AS biomarker_id, CASE WHEN p_size % 5 = 0 THEN 'child' ELSE 'adult' END AS population, CASE WHEN p_size % 2 = 0 THEN 'EU' ELSE 'US' END AS jurisdiction,
  CASE p_size % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'unknown' END AS sex, CASE WHEN p_size % 4 < 2 THEN 'fasting' ELSE 'fed' END AS fasting, CASE WHEN p_size % 7 = 0 THEN 'screening' END AS purpose, 'serum' AS specimen FROM part)
SELECT p_partkey, guidance_id FROM c JOIN g USING (biomarker_id, population, jurisdiction) WHERE c.sex <> 'unknown' AND (g.sex = 'all' OR g.sex = c.sex) AND (g.fasting = 'any' OR g.fasting = c.fasting)
  AND (g.purpose IS NULL OR g.purpose = c.purpose) AND (g.specimen IS NULL OR g.specimen = c.specimen)"""
)
def guidance_applicability(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    c = s.read(spark, d, "part").select(
        "p_partkey", F.col("p_brand").alias("biomarker_id"), F.when(size % 5 == 0, "child").otherwise("adult").alias("population"), F.when(size % 2 == 0, "EU").otherwise("US").alias("jurisdiction"),
        F.when(size % 3 == 0, "male").when(size % 3 == 1, "female").otherwise("unknown").alias("sex"), F.when(size % 4 < 2, "fasting").otherwise("fed").alias("fasting"), F.when(size % 7 == 0, "screening").alias("purpose"), F.lit("serum").alias("specimen"),
    )
    g = spark.createDataFrame(GUIDANCE, "biomarker_id string, guidance_id string, population string, jurisdiction string, sex string, fasting string, purpose string, specimen string")
    return catalogue.applicable_guidance(c, g).select("p_partkey", "guidance_id")


@query("""SELECT p_partkey, p_retailprice AS price, CASE WHEN p_retailprice = 0 THEN 0 ELSE round(p_retailprice * pow(10.0, 3 - floor(log10(abs(p_retailprice))))) / pow(10.0, 3 - floor(log10(abs(p_retailprice)))) END AS shown FROM part""")
def significant_digits(spark: SparkSession, d: str) -> DataFrame:
    return s.read(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("price"), numbers.four_digits(F.col("p_retailprice")).alias("shown"))


@query("""WITH e AS (SELECT p_partkey, p_name || ' ' || p_type AS text FROM part), p(profile_id, a, t) AS (VALUES ('p1', 'STEEL', 'PROMO'), ('p2', 'BRASS', 'ECONOMY'), ('p3', 'STEEL', 'STANDARD'))
SELECT p_partkey, CASE WHEN count(profile_id) = 1 THEN min(profile_id) END AS profile_id FROM e LEFT JOIN p ON contains(lower(text), lower(a)) AND contains(lower(text), lower(t)) GROUP BY 1""")
def method_profiles(spark: SparkSession, d: str) -> DataFrame:
    profile = lambda i, a, t: F.struct(F.lit(i).alias("profile_id"), F.array(F.lit(a)).alias("assay_patterns"), F.array(F.lit(t)).alias("temperature_patterns"), F.array(F.lit("")).alias("cofactor_patterns"))
    profiles = F.array(profile("p1", "STEEL", "PROMO"), profile("p2", "BRASS", "ECONOMY"), profile("p3", "STEEL", "STANDARD"))
    return s.read(spark, d, "part").select("p_partkey", catalogue.method_profile(F.concat_ws(" ", "p_name", "p_type"), profiles).alias("profile_id"))


@query(f"""WITH {MEASUREMENTS} SELECT record_id, round(num, 6) AS upper_median FROM (SELECT record_id, list_sort(list(num))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS num FROM measurements GROUP BY 1)""")
def upper_median(spark: SparkSession, d: str) -> DataFrame:
    return summaries.upper_median(s.measurements(spark, d), ["record_id"], "num").select("record_id", F.round("upper_median", 6).alias("upper_median"))


@query("""SELECT user_id, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1""")
def nearest_rank_percentile(spark: SparkSession, d: str) -> DataFrame:
    values = s.events(spark, d).where("value is not null")
    return summaries.nearest_rank(values, ["user_id"], "value", {"p50": 0.5, "p95": 0.95}).join(values.groupBy("user_id").agg(F.count("*").alias("n")), "user_id")
