"""Scans, parents with children, state predicates and first picks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scans, source_rows
from . import standins as s
from .registry import Registry
from .standins import MEASUREMENTS, RECORDS

_own = Registry()
query, QUERIES, ORACLES = _own.query, _own.queries, _own.oracles


@query(f"""WITH {RECORDS} SELECT record_id, row_number() OVER (ORDER BY coalesce(CAST(collection_date AS VARCHAR), '9999-12-31') DESC, record_ordinal DESC) AS position FROM records""")
def records_scan(spark: SparkSession, d: str) -> DataFrame:
    day = F.coalesce(F.col("collection_date").cast("string"), F.lit("9999-12-31"))
    rows = s.records(spark, d).select("record_id", day.alias("day"), "record_ordinal")
    return scans.numbered(rows, [F.desc("day"), F.desc("record_ordinal")]).select("record_id", "position")


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey) AS position FROM orders""")
def reports_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = s.read(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return scans.numbered(rows, [F.desc("o_orderdate"), F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_orderkey", "position")


@query("""SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS position FROM events""")
def events_scan(spark: SparkSession, d: str) -> DataFrame:
    return scans.numbered(s.events(spark, d).select("event_id", "ts"), [F.asc("ts"), F.asc("event_id")]).select("event_id", "position")


@query(f"""WITH {RECORDS}, {MEASUREMENTS} SELECT record_id, count(measurement_id) AS n_children, coalesce(string_agg(CAST(measurement_id AS VARCHAR), ',' ORDER BY measurement_ordinal, measurement_id), '') AS children
FROM records LEFT JOIN measurements USING (record_id) GROUP BY 1""")
def measurements_by_record(spark: SparkSession, d: str) -> DataFrame:
    found = scans.children(s.records(spark, d), s.measurements(spark, d), "record_id", ["measurement_ordinal"], "measurement_id")
    return found.withColumn("children", F.array_join(F.transform("children", lambda x: x.cast("string")), ","))


_REPORTS = "CASE o_orderstatus WHEN 'F' THEN 'imported' WHEN 'P' THEN 'deleted' END"


@query(f"""WITH r AS (SELECT o_orderkey, {_REPORTS} AS state FROM orders), l AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT o_orderkey, state IS DISTINCT FROM 'deleted' AS active, state IS DISTINCT FROM 'deleted' AND (state IS DISTINCT FROM 'imported' OR coalesce(n, 0) = 0) AS unfinished FROM r LEFT JOIN l ON l_orderkey = o_orderkey""")
def unfinished_reports(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "imported").when(F.col("o_orderstatus") == "P", "deleted")
    linked = s.read(spark, d, "lineitem").where("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    r = s.read(spark, d, "orders").select("o_orderkey", state.alias("state")).join(linked, "o_orderkey", "left")
    return r.select("o_orderkey", scans.is_active(F.col("state")).alias("active"), scans.is_unfinished(F.col("state"), F.col("n")).alias("unfinished"))


@query("""WITH w AS (SELECT o_custkey, min(o_orderdate) AS first_at FROM orders GROUP BY 1) SELECT c_custkey, CAST(CAST(coalesce(CASE WHEN c_custkey % 3 = 0 THEN DATE '1990-01-01' END, first_at) AS DATE) AS VARCHAR) AS confirmed_at FROM customer LEFT JOIN w ON o_custkey = c_custkey""")
def first_write_timestamps(spark: SparkSession, d: str) -> DataFrame:
    stored = s.read(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.to_date(F.lit("1990-01-01"))).alias("confirmed_at"))
    writes = s.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.to_date(F.min("o_orderdate")).alias("confirmed_at"))
    return scans.first_write_wins(stored, writes, ["c_custkey"], "confirmed_at").withColumn("confirmed_at", F.col("confirmed_at").cast("string"))


@query("SELECT coalesce(max(CASE WHEN p_size < 0 THEN p_size END), 0) AS version, 'none' AS kind FROM part UNION ALL SELECT coalesce(max(p_size), 0), 'sizes' FROM part")
def latest_schema_version(spark: SparkSession, d: str) -> DataFrame:
    part = s.read(spark, d, "part")
    return scans.schema_version(part.where("p_size < 0"), "p_size").withColumn("kind", F.lit("none")).unionByName(scans.schema_version(part, "p_size").withColumn("kind", F.lit("sizes")))


@query("SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.05) AS n_lines, (SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey) IS NOT NULL AS has_lines FROM orders")
def scalar_subqueries(spark: SparkSession, d: str) -> DataFrame:
    """Correlated scalar subqueries as one aggregate and one join."""
    lines = s.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.when(F.col("l_discount") > 0.05, 1)).alias("n"), F.max("l_shipdate").alias("last"))
    return s.read(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_lines"), F.col("last").isNotNull().alias("has_lines"))


@query("""WITH r AS (SELECT l_orderkey AS report_id, l_linenumber AS page FROM lineitem), sc AS (SELECT o_orderkey AS report_id, 1 + o_custkey % 7 AS page FROM orders)
SELECT kept, count(*) AS n FROM (SELECT EXISTS (SELECT 1 FROM sc WHERE sc.report_id = r.report_id AND sc.page = r.page) AS kept FROM r) GROUP BY 1""")
def page_scope(spark: SparkSession, d: str) -> DataFrame:
    rows = s.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").cast("long").alias("page"))
    scope = s.read(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), (1 + F.col("o_custkey") % 7).alias("page"))
    kept, rejected = scans.in_scope(rows, scope, ["report_id", "page"])
    return kept.withColumn("kept", F.lit(True)).unionByName(rejected.withColumn("kept", F.lit(False))).groupBy("kept").agg(F.count("*").alias("n"))


@query(f"""WITH {RECORDS}, {MEASUREMENTS}, m AS (SELECT record_id, count(*) AS n, count(CASE WHEN review_state = 'needs-review' THEN 1 END) AS n_review FROM measurements GROUP BY 1)
SELECT subject_id, arg_min(CASE WHEN n > 0 THEN record_id END, CASE WHEN n > 0 THEN record_ordinal END) AS first_measured, arg_min(CASE WHEN n_review > 0 THEN record_id END, CASE WHEN n_review > 0 THEN record_ordinal END) AS first_to_review
FROM records LEFT JOIN m USING (record_id) GROUP BY 1""")
def first_records(spark: SparkSession, d: str) -> DataFrame:
    m = s.measurements(spark, d).groupBy("record_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("review_state") == "needs-review", 1)).alias("n_review"))
    rows = s.records(spark, d).join(m, "record_id", "left")
    first = lambda c, name: scans.first_where(rows, ["subject_id"], ["record_ordinal"], "record_id", F.coalesce(F.col(c) > 0, F.lit(False))).withColumnRenamed("record_id", name)
    return first("n", "first_measured").join(first("n_review", "first_to_review"), "subject_id")


@query("SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 100")
def expired_batch(spark: SparkSession, d: str) -> DataFrame:
    return scans.batch_to_delete(s.events(spark, d), F.col("event_type") == "error", [F.asc("ts"), F.asc("event_id")], 100).select("event_id")


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY first_at) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first_at FROM events GROUP BY 1, 2) GROUP BY 1")
def kinds_in_order(spark: SparkSession, d: str) -> DataFrame:
    return scans.unique_in_order(s.events(spark, d), ["user_id"], ["event_id"], "event_type").select("user_id", F.array_join("values", ",").alias("kinds"))


_COMMON = ["mg/dL", "mmol/L", "g/L", "U/L"]


@query(f"""WITH {MEASUREMENTS}, u AS (SELECT biomarker_id, CASE WHEN measurement_id % 2 = 0 THEN upper(unit) ELSE unit END AS unit, measurement_id FROM measurements WHERE unit IS NOT NULL AND biomarker_id IS NOT NULL),
f AS (SELECT biomarker_id, lower(unit) AS low, min(measurement_id) AS first_at, arg_min(unit, measurement_id) AS unit FROM u GROUP BY 1, 2)
SELECT biomarker_id, string_agg(unit, ',' ORDER BY first_at) AS suggested, (SELECT coalesce(string_agg(c, ',' ORDER BY i), '') FROM (VALUES (1, 'mg/dL'), (2, 'mmol/L'), (3, 'g/L'), (4, 'U/L')) v(i, c) WHERE NOT list_contains(list(f.low), lower(c))) AS others FROM f GROUP BY 1""")
def suggested_units(spark: SparkSession, d: str) -> DataFrame:
    m = s.measurements(spark, d).where("biomarker_id is not null").withColumn("unit", F.when(F.col("measurement_id") % 2 == 0, F.upper("unit")).otherwise(F.col("unit")))
    found = scans.units_in_order(m, ["biomarker_id"], ["measurement_id"], "unit", _COMMON)
    return found.select("biomarker_id", F.array_join("suggested", ",").alias("suggested"), F.array_join("others", ",").alias("others"))


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 5 = 0 THEN 'promo:' || l_orderkey ELSE 'grant:' || l_orderkey || ':' || l_linenumber END AS source FROM lineitem), p AS (SELECT CAST(o_orderkey AS VARCHAR) AS tx, o_custkey FROM orders WHERE o_orderkey % 4 <> 0)
SELECT l_linenumber, count(*) AS n, count(o_custkey) AS n_found, CAST(sum(o_custkey) AS BIGINT) AS total FROM g LEFT JOIN p ON starts_with(source, 'grant:' || tx || ':') AND tx = split_part(source, ':', 2) GROUP BY 1""")
def grant_purchases(spark: SparkSession, d: str) -> DataFrame:
    order, line = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")
    g = s.read(spark, d, "lineitem").select("l_linenumber", F.when(F.col("l_linenumber") % 5 == 0, F.concat(F.lit("promo:"), order)).otherwise(F.concat_ws(":", F.lit("grant"), order, line)).alias("source"))
    p = s.read(spark, d, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").cast("string").alias("transaction_id"), "o_custkey")
    return scans.grant_purchases(g, p).groupBy("l_linenumber").agg(F.count("*").alias("n"), F.count("o_custkey").alias("n_found"), F.sum("o_custkey").alias("total"))


@query("""WITH e AS (SELECT l_orderkey AS k, string_agg(CAST(l_partkey % 3 AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS ids FROM lineitem GROUP BY 1), c AS (SELECT ids, count(*) AS n FROM e GROUP BY 1)
SELECT s_nationkey, count(*) AS n, CAST(sum(c.n) AS BIGINT) AS n_rows FROM (SELECT s_nationkey, s_suppkey % 3 || ',' || s_nationkey % 3 AS ids FROM supplier) x JOIN c USING (ids) GROUP BY 1""")
def source_id_sequences(spark: SparkSession, d: str) -> DataFrame:
    e = s.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda r: r["l_partkey"] % 3).alias("ids"))
    counts = e.groupBy("ids").agg(F.count("*").alias("n"))
    x = s.read(spark, d, "supplier").select("s_nationkey", F.array(F.col("s_suppkey") % 3, (F.col("s_nationkey") % 3).cast("long")).alias("ids"))
    return scans.by_sequence(x, counts, "ids").groupBy("s_nationkey").agg(F.count("*").alias("n_pairs"), F.sum("n").alias("n_rows")).select("s_nationkey", F.col("n_pairs").alias("n"), "n_rows")


@query("""SELECT p_partkey, """ + ", ".join(f"""CAST(list_reduce(list_prepend(CAST({seed} AS HUGEINT), list_transform(string_split(p_name, ''), lambda x: CAST(unicode(x) AS HUGEINT))), lambda h, c: (xor(h, c) * 16777619) & CAST(4294967295 AS HUGEINT)) AS BIGINT) AS h{i}""" for i, seed in enumerate(scans.FNV_SEEDS)) + " FROM part")
def row_ids_fnv(spark: SparkSession, d: str) -> DataFrame:
    return s.read(spark, d, "part").select("p_partkey", *[scans.fnv1a(F.col("p_name"), seed).alias(f"h{i}") for i, seed in enumerate(scans.FNV_SEEDS)])


@query("""WITH c AS (SELECT l_suppkey, count(*) AS n_rows, count(CASE WHEN l_quantity > 10 THEN 1 END) AS n_referenced, count(CASE WHEN l_quantity > 20 THEN 1 END) AS n_admitted, count(CASE WHEN l_quantity > 25 THEN 1 END) AS n_correct, count(CASE WHEN l_quantity < 8 THEN 1 END) AS n_review, count(CASE WHEN l_tax > 0.06 THEN 1 END) AS n_duplicates FROM lineitem GROUP BY 1)
SELECT *, n_referenced <= n_rows AND n_correct <= n_admitted AND n_admitted + n_review <= n_rows AS valid, round(n_referenced / n_rows, 9) AS raw_recall, round(n_correct / n_rows, 9) AS recall, CASE WHEN n_admitted + n_duplicates = 0 THEN 0 ELSE round(n_correct / (n_admitted + n_duplicates), 9) END AS precision, round(n_review / n_rows, 9) AS review_burden FROM c""")
def physical_rows(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    q = F.col("l_quantity")
    c = s.read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n_rows"), n(q > 10, "n_referenced"), n(q > 20, "n_admitted"), n(q > 25, "n_correct"), n(q < 8, "n_review"), n(F.col("l_tax") > 0.06, "n_duplicates"))
    found = scans.physical_row_metrics(c)
    return found.select(*c.columns, "valid", *[F.round(x, 9).alias(x) for x in ("raw_recall", "recall", "precision", "review_burden")])


#: Each line of an order as a line of a report in one of thirteen forms; %b is the brand, %q the quantity, %u the unit.
_FORMS = ["%b %q %u 3.5 - 5.1", "%b 37 °C %q %u,", "%b <%q %u", "%b  %q <200 %u", "%b %q 7.5 %u", "%b %u", "%b %q 10–20", "%b < %q %u", "%b %q, %u", "%b -%q %u", "%q %u 70 - <99", "%b %q%u 70-99", "%b nicht nachgewiesen"]
_ROWS = f"""f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus, (l_orderkey + l_linenumber) % 13 AS form, translate(p_brand, '#0123456789', 'xabcdefghij') AS brand, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS q, ['mg/dL', 'mmol/L', 'U/L'][1 + l_partkey % 3] AS u FROM lineitem JOIN part ON p_partkey = l_partkey),
r AS (SELECT *, replace(replace(replace({_FORMS!r}[1 + form], '%b', brand), '%q', q), '%u', u) AS text FROM f)"""


def _lettered(brand: str) -> F.Column:
    """A brand without digits, which would count as numbers of the line."""
    return F.translate(brand, "#0123456789", "xabcdefghij")


def _source_rows(spark: SparkSession, d: str) -> DataFrame:
    item, part = s.read(spark, d, "lineitem"), s.read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), _lettered("p_brand").alias("brand"))
    said = F.get(F.array(*[F.lit(f) for f in _FORMS]), ((F.col("l_orderkey") + F.col("l_linenumber")) % 13).cast("int"))
    units = F.get(F.array(F.lit("mg/dL"), F.lit("mmol/L"), F.lit("U/L")), (F.col("l_partkey") % 3).cast("int"))
    for mark, value in (("%b", F.col("brand")), ("%q", F.col("l_quantity").cast("int").cast("string")), ("%u", units)):
        said = F.replace(said, F.lit(mark), value)
    return item.join(part, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "brand", F.col("l_quantity").cast("int").alias("q"), said.alias("text"))


def _aliases(spark: SparkSession, d: str) -> DataFrame:
    return s.entries(spark, d).select(_lettered("biomarker_id").alias("entry_id"), _lettered("biomarker_id").alias("alias"))


@query(f"""WITH {_ROWS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN form IN (4, 5, 10, 11) THEN text WHEN form = 1 THEN brand || ' 37 °C' ELSE brand END AS label,
  CASE form WHEN 2 THEN '<' || q WHEN 7 THEN '< ' || q WHEN 9 THEN '-' || q WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 11 THEN NULL WHEN 12 THEN 'nicht nachgewiesen' ELSE q END AS value, CASE WHEN form NOT IN (6, 11, 12) THEN u END AS unit,
  CASE form WHEN 0 THEN '3.5 - 5.1' WHEN 3 THEN '<200' WHEN 6 THEN '10–20' WHEN 10 THEN '70 - <99' WHEN 11 THEN '70-99' END AS reference, CASE WHEN form = 4 THEN 2 WHEN form IN (5, 11, 12) THEN 0 ELSE 1 END AS n_values FROM r""")
def source_row_reader(spark: SparkSession, d: str) -> DataFrame:
    return source_rows.read_rows(_source_rows(spark, d), "text", repeated=True).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "label", "value", "unit", "reference", "n_values")


_READ = f"""{_ROWS}, k AS (SELECT *, brand NOT LIKE '%f' AND form <> 10 AS known, u = 'U/L' AND form NOT IN (6, 11, 12) AS risk FROM r),
e AS (SELECT *, risk AND (NOT known OR brand LIKE '%e') AS unsafe, known AND NOT (risk AND brand LIKE '%e') AS entry FROM k)"""


def _read(spark: SparkSession, d: str) -> DataFrame:
    """With entries for brands; in those that end in e a unit of U/L is an unsafe alias."""
    aliases = _aliases(spark, d)
    return source_rows.read_rows(_source_rows(spark, d), "text", aliases, aliases.where("entry_id LIKE '%e'").select("entry_id", F.lit("u/l").alias("alias")))


@query(f"""WITH {_READ}, x AS (SELECT *, [CASE WHEN form IN (4, 5, 11) THEN 'missing-value' END, CASE WHEN form IN (4, 5, 11) THEN 'unparseable-value' END, CASE WHEN NOT entry THEN 'unsupported-alias' END, CASE WHEN form = 6 THEN 'missing-unit' END,
  CASE WHEN entry AND risk THEN 'incompatible-unit' END, CASE WHEN entry AND brand LIKE '%b' AND l_linestatus <> 'F' THEN 'incompatible-specimen' END, CASE WHEN unsafe THEN 'ambiguous-assay' END, CASE WHEN entry AND brand LIKE '%c' AND form <> 1 THEN 'incompatible-method' END,
  CASE WHEN l_orderkey % 11 = 0 THEN 'missing-collection-date' END, CASE WHEN l_orderkey % 7 = 0 THEN 'ambiguous-date' END, CASE WHEN form = 4 THEN 'unsupported-layout' END, CASE WHEN l_orderkey % 11 <> 0 AND l_orderkey % 5 = 0 THEN 'defaulted-collection-date' END] AS all_reasons FROM e),
y AS (SELECT *, list_filter(all_reasons, lambda x: x IS NOT NULL) AS reasons FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(reasons, ',') AS reasons, list_has_any(reasons, {source_rows.BLOCKING_REASONS!r}) AS blocked, len(list_filter(reasons, lambda x: x <> 'defaulted-collection-date')) = 0 AS resolved FROM y""")
def review_reasons(spark: SparkSession, d: str) -> DataFrame:
    serum = F.when(F.col("entry_id").endswith("b"), F.array(F.lit("serum")))
    entries = _aliases(spark, d).select("entry_id", F.array(F.lit("mg/dL"), F.lit("mmol/L")).alias("units"), serum.alias("specimens"))
    order = F.col("l_orderkey")
    date, specimen = F.when(order % 11 != 0, F.lit("2024-01-01")), F.when(F.col("l_linestatus") == "F", "serum").otherwise("blood")
    method = F.when(F.col("entry_id").endswith("c"), F.col("text").contains("37 °C"))
    found = source_rows.review_reasons(_read(spark, d), entries, date=date, date_defaulted=order % 5 == 0, date_ambiguous=order % 7 == 0, specimen=specimen, method_ok=method)
    r = F.col("reasons")
    blocked, resolved = source_rows.blocks_confirmation(r, F.lit("unresolved")), source_rows.default_decision(r) == "resolve"
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(r, ",").alias("reasons"), blocked.alias("blocked"), resolved.alias("resolved"))


@query(f"""WITH {_READ} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN entry THEN brand WHEN form IN (4, 5, 10, 11) THEN text WHEN form = 1 THEN brand || ' 37 °C' ELSE brand END AS label, CASE WHEN entry THEN brand END AS entry_id FROM e
WHERE entry AND form <> 5 OR form NOT IN (4, 5, 11)""")
def measurement_shaped_rows(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d).where(source_rows.is_measurement_shaped(F.col("text"))).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "label", "entry_id")


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_orderkey + l_linenumber) % 6 AS k, translate(p_brand, '#0123456789', 'xabcdefghij') AS brand, CAST(l_quantity AS INTEGER) AS q FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN brand LIKE '%f' OR k = 4 THEN brand || [' ' || q || ' mg/dl', ' 1.5-' || q || ' MG / DL H', '  h ' || q, '', ' ' || (q + 1), ' mg/dL ' || q || ',0'][1 + k] ELSE brand END AS display FROM m""")
def display_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels that repeat fields of their row, in six forms; the fifth has a number that is not the row's value."""
    rows = _source_rows(spark, d)
    q, k = F.col("q").cast("string"), (F.col("l_orderkey") + F.col("l_linenumber")) % 6
    said = F.array(F.concat(F.lit(" "), q, F.lit(" mg/dl")), F.concat(F.lit(" 1.5-"), q, F.lit(" MG / DL H")), F.concat(F.lit("  h "), q), F.lit(""), F.concat(F.lit(" "), (F.col("q") + 1).cast("string")), F.concat(F.lit(" mg/dL "), q, F.lit(",0")))
    labels = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat("brand", F.get(said, k.cast("int"))).alias("label"), q.alias("value"), F.lit("mg/dL").alias("unit"), F.concat(F.lit("1.5-"), q).alias("reference"), F.lit("H").alias("flag"))
    return source_rows.display_labels(labels, _aliases(spark, d)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "display")


#: Every line of documents through the reader of rows; SQL has no matches with places, so this is tested against plain regular expressions.
@query()
def source_values(spark: SparkSession, d: str) -> DataFrame:
    lines = s.lines(spark, d).withColumnRenamed("line", "line_no")
    return source_rows.read_rows(lines, "text").select("doc_id", "line_no", "label", "value", "value_kind", "unit", "reference", "flag", "n_values", "n_references")
