"""Routes, ownership, admission and answers of readers over the driver's tables: ten orders' numbers are a page, line items its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout, pages, source_rows
from ..operators.scans import shuffle_parts
from . import scans
from . import standins as s
from .registry import Registry

_own = Registry()
query, QUERIES, ORACLES = _own.query, _own.queries, _own.oracles


@query("""SELECT doc_id, CASE WHEN n = 0 THEN 'empty-observations' WHEN t IS NOT NULL AND NOT regexp_matches(t, '\\S') THEN 'empty-source-text' WHEN t IS NULL OR source IS NULL OR lang IS NULL THEN 'mixed-or-unknown-provenance'
  WHEN source <> 'web' OR lang <> 'en' THEN 'no-selectable-text-provenance' ELSE 'bound-selectable-text-source' END AS reason
  FROM (SELECT doc_id, lang, CASE WHEN doc_id % 13 <> 0 THEN source END AS source, n_chars % 29 AS n, CASE doc_id % 31 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE text END AS t FROM documents)""")
def page_routes(spark: SparkSession, d: str) -> DataFrame:
    docs, i = s.read(spark, d, "documents"), F.col("doc_id")
    text = F.when(i % 31 == 0, " ").when(i % 31 != 1, F.col("text"))
    provenance = {"origin": (F.when(i % 13 != 0, F.col("source")), "web"), "language": (F.col("lang"), "en")}
    return docs.select("doc_id", pages.route_reason(F.col("n_chars") % 29, text, provenance).alias("reason"))


_ITEMS = "i AS (SELECT l_orderkey // 10 AS page, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM lineitem)"


def _items(spark: SparkSession, d: str) -> DataFrame:
    return s.read(spark, d, "lineitem").select(F.expr("l_orderkey div 10").alias("page"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")


@query(f"""WITH {_ITEMS}, fast AS (SELECT page, l_orderkey * 10 + l_linenumber AS row_id, l_returnflag AS label, l_suppkey AS num FROM i WHERE page % 3 <> 0),
slow AS (SELECT page, l_orderkey * 10 + l_linenumber % 3 - (page % 2) * 10 AS row_id, l_returnflag AS label, l_suppkey % 10 AS num, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey * 100 + l_suppkey % 100 AS seq, l_partkey FROM i WHERE page % 3 = 0),
a AS (SELECT page, label, num, arg_min(row_id, (seq, l_partkey)) AS row_id, min((seq, l_partkey)) AS o FROM slow GROUP BY 1, 2, 3), b AS (SELECT row_id, arg_min((page, label, num), o) AS r FROM a GROUP BY 1)
SELECT page, row_id, label, num, FALSE AS from_fallback FROM fast UNION ALL SELECT r[1], row_id, r[2], r[3], TRUE FROM b WHERE row_id NOT IN (SELECT row_id FROM fast)""")
def merged_readings(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose number three divides are deferred; the fallback reads all pages."""
    i, c = _items(spark, d), F.col
    fast = i.where("page % 3 <> 0").select("page", (c("l_orderkey") * 10 + c("l_linenumber")).alias("row_id"), c("l_returnflag").alias("label"), c("l_suppkey").alias("num"))
    seq = (c("l_orderkey") * 10 + c("l_linenumber")).cast("long") * 10000000 + c("l_partkey") * 100 + c("l_suppkey") % 100
    slow = i.select("page", (c("l_orderkey") * 10 + c("l_linenumber") % 3 - (c("page") % 2) * 10).alias("row_id"), c("l_returnflag").alias("label"), (c("l_suppkey") % 10).alias("num"), seq.alias("seq"), "l_partkey")
    deferred = i.where("page % 3 = 0").select("page")
    return pages.merged_readings(fast, slow, deferred, ["page"], ["label", "num"], "row_id", ["seq", "l_partkey"])


_CORRIDOR = f"""{_ITEMS}, t AS (SELECT page, (l_orderkey * 10 + l_linenumber) * 1000 + l_partkey % 1000 AS row_id, l_suppkey, l_partkey, l_orderkey % 10 * 100 + l_linenumber * 10 + l_partkey % 7 AS top,
  CASE WHEN l_linenumber > 1 THEN 'absent' WHEN l_orderkey % 4 = 0 THEN 'ambiguous' ELSE 'column' END AS kind FROM i),
n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY top, row_id, l_partkey, l_suppkey) AS k FROM t)"""


@query(f"""WITH {_CORRIDOR}, h AS (SELECT n.*, max(o.k) AS hk FROM n LEFT JOIN n o ON o.page = n.page AND o.k < n.k AND o.kind <> 'absent' GROUP BY ALL),
g AS (SELECT c.page, c.k, c.top - (p.top + 5 + p.l_suppkey % 4) AS gap FROM n c JOIN n p ON p.page = c.page AND p.k = c.k - 1),
b AS (SELECT h.page, h.k, max(g.gap) AS widest FROM h JOIN g ON g.page = h.page AND g.k > h.hk AND g.k <= h.k GROUP BY 1, 2)
SELECT h.row_id, h.l_partkey, h.l_suppkey, CASE WHEN o.kind = 'column' AND (h.page % 5 = 0 OR b.widest <= 9) THEN o.row_id END AS header_id FROM h LEFT JOIN b ON b.page = h.page AND b.k = h.k LEFT JOIN n o ON o.page = h.page AND o.k = h.hk""")
def header_corridors(spark: SparkSession, d: str) -> DataFrame:
    """First lines of orders are headers; pages that five divides are tables."""
    c = F.col
    top = c("l_orderkey") % 10 * 100 + c("l_linenumber") * 10 + c("l_partkey") % 7
    kind = F.when(c("l_linenumber") > 1, "absent").when(c("l_orderkey") % 4 == 0, "ambiguous").otherwise("column")
    rows = _items(spark, d).select("page", ((c("l_orderkey") * 10 + c("l_linenumber")) * 1000 + c("l_partkey") % 1000).alias("row_id"), "l_partkey", "l_suppkey", top.alias("top"), (top + 5 + c("l_suppkey") % 4).alias("bottom"), kind.alias("kind"))
    owned = pages.owned_in_corridor(rows, ["page"], ["top", "row_id", "l_partkey", "l_suppkey"], top="top", bottom="bottom", row_id="row_id", header_kind="kind", in_table=c("page") % 5 == 0, most_gap=9)
    return owned.select("row_id", "l_partkey", "l_suppkey", "header_id")


_COLUMNS = f"""{_ITEMS}, h AS (SELECT page, CAST(l_partkey % 1000 AS DOUBLE) AS x, row_number() OVER (PARTITION BY page ORDER BY l_partkey % 1000) AS k FROM i WHERE l_linenumber = 1),
f AS (SELECT page, k, [x] AS run, 1 AS n FROM h WHERE k = 1 UNION ALL
  SELECT h.page, h.k, CASE WHEN abs(h.x - list_median(run)) <= 30 THEN list_append(run, h.x) ELSE [h.x] END, CASE WHEN abs(h.x - list_median(run)) <= 30 THEN n ELSE n + 1 END FROM f JOIN h ON h.page = f.page AND h.k = f.k + 1),
c AS (SELECT page, n, list_median(arg_max(run, k)) AS center FROM f GROUP BY 1, 2),
v AS (SELECT page, l_orderkey, l_linenumber, CAST(l_partkey % 1000 AS DOUBLE) AS x FROM i WHERE l_linenumber BETWEEN 2 AND 4),
m AS (SELECT v.*, center FROM v JOIN c ON c.page = v.page AND abs(x - center) <= 30), s AS (SELECT page, center FROM m GROUP BY 1, 2 HAVING count(DISTINCT l_orderkey) >= 2)"""


def _admission(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines 2 to 4 of an order are the variants of its group; columns are where first lines are."""
    i = _items(spark, d).withColumn("x", (F.col("l_partkey") % 1000).cast("double"))
    centers = pages.column_centers(i.where("l_linenumber = 1"), ["page"], "x", 30)
    variants = i.where("l_linenumber between 2 and 4")
    groups, counted = pages.admitted_by_column(variants, centers, ["page"], group="l_orderkey", variant="l_linenumber", x="x", tolerance=30)
    return i, groups, counted


@query(f"""WITH RECURSIVE {_COLUMNS}, g AS (SELECT page, l_orderkey, count(DISTINCT l_linenumber) AS hits, min(l_linenumber) AS one FROM m SEMI JOIN s USING (page, center) GROUP BY 1, 2)
SELECT DISTINCT v.page, v.l_orderkey, CASE WHEN v.page NOT IN (SELECT page FROM s) THEN 'admitted' WHEN hits IS NULL THEN 'excluded' WHEN hits > 1 THEN 'review' ELSE 'admitted' END AS outcome, CASE WHEN hits = 1 THEN one END AS l_linenumber
FROM v LEFT JOIN g ON g.page = v.page AND g.l_orderkey = v.l_orderkey""")
def column_admission(spark: SparkSession, d: str) -> DataFrame:
    return _admission(spark, d)[1]


@query(f"""WITH RECURSIVE {_COLUMNS} SELECT i.page, i.l_orderkey, count(DISTINCT i.l_partkey % 1000) AS n_anchors FROM i JOIN s ON s.page = i.page AND abs(i.l_partkey % 1000 - s.center) <= 30
WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.page = i.page AND v.l_orderkey = i.l_orderkey) GROUP BY 1, 2""")
def unrepresented_rows(spark: SparkSession, d: str) -> DataFrame:
    """Orders without lines 2 to 4 have no group."""
    i, groups, counted = _admission(spark, d)
    return pages.unrepresented(i, groups, counted, ["page"], row="l_orderkey", x="x", tolerance=30)


@query(f"""WITH {scans._ROWS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE form WHEN 2 THEN '<' || q WHEN 7 THEN '< ' || q WHEN 9 THEN '-' || q ELSE q END AS value, CASE WHEN form IN (2, 7) THEN 'bounded' ELSE 'numeric' END AS value_type FROM r WHERE form NOT IN (4, 5, 11, 12)""")
def associated_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = source_rows.read_rows(scans._source_rows(spark, d), "text", repeated=True)
    return pages.associated(rows).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "value", "value_type")


_FORMS = [
    '{"rows":[{"label":" %s ","value":"1","unit":null,"reference_interval":" ","flag":"H"}]}', '{"rows":[{"label":"%s","value":"1","unit":null,"flag":null}]}', '{"rows":[],"note":"%s"}', '{"rows":[{"label":"%s"', '["%s"]',
    '{"rows":[{"label":"%s","value":"1","unit":null,"reference_interval":null,"flag":null},{"label":"b","value":2,"unit":null,"reference_interval":null,"flag":null}]}', '{"rows":[{"label":null,"value":"%s","unit":null,"reference_interval":null,"flag":null}]}',
]
_MANY = '{"label":"%s","value":null,"unit":"g/L","reference_interval":null,"flag":null},'


@query(f"""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 < 7 THEN replace({_FORMS!r}[1 + o_orderkey % 9], '%s', o_orderpriority) ELSE '{{"rows":[' || rtrim(replace(repeat('{_MANY}', CAST(73 + o_orderkey % 9 AS INTEGER)), '%s', o_orderpriority), ',') || ']}}' END AS raw FROM orders),
j AS (SELECT *, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS v FROM o), r AS (SELECT *, CASE WHEN json_type(v) = 'OBJECT' AND json_keys(v) = ['rows'] AND json_type(v, '$.rows') = 'ARRAY' THEN json_extract(v, '$.rows[*]') END AS rs FROM j),
b AS (SELECT *, list_position(list_transform(rs, lambda x: json_type(x) = 'OBJECT' AND list_sort(json_keys(x)) = ['flag', 'label', 'reference_interval', 'unit', 'value'] AND trim(coalesce(x ->> '$.label', '')) <> ''
  AND len(list_filter([json_type(x, '$.label'), json_type(x, '$.value'), json_type(x, '$.unit'), json_type(x, '$.reference_interval'), json_type(x, '$.flag')], lambda t: t NOT IN ('VARCHAR', 'NULL'))) = 0), FALSE) AS bad FROM r),
e AS (SELECT *, CASE WHEN v IS NULL THEN 'malformed-json' WHEN rs IS NULL THEN 'malformed-envelope' WHEN len(rs) > 80 THEN 'too-many-rows' WHEN bad > 0 THEN 'row-' || (bad - 1) || '-malformed' END AS error FROM b)
SELECT o_orderkey, error, CASE WHEN error IS NULL THEN len(rs) END AS n_rows, CASE WHEN error IS NULL THEN trim(rs[1] ->> '$.label') END AS label, CASE WHEN error IS NULL THEN nullif(trim(rs[1] ->> '$.reference_interval'), '') END AS reference FROM e""")
def decoded_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers in seven forms, and such of 80 and of 81 rows."""
    k = (F.col("o_orderkey") % 9).cast("int")
    many = F.concat(F.lit('{"rows":['), F.rtrim(F.repeat(F.lit(_MANY), k + 73), F.lit(",")), F.lit("]}"))
    form = F.when(k < 7, F.get(F.array(*[F.lit(f) for f in _FORMS]), k)).otherwise(many)
    # few orders make many long answers, so they are dealt out before
    orders = s.read(spark, d, "orders").select("o_orderkey", "o_orderpriority").repartition(shuffle_parts(spark), "o_orderkey")
    answers = orders.select("o_orderkey", F.replace(form, F.lit("%s"), "o_orderpriority").alias("raw"))
    rows = pages.decoded_answers(answers, "raw")
    return rows.select("o_orderkey", "error", F.when(F.col("error").isNull(), F.size("rows")).cast("long").alias("n_rows"), F.get("rows", F.lit(0))["label"].alias("label"), F.get("rows", F.lit(0))["reference_interval"].alias("reference"))


@query(f"""WITH {_ITEMS} SELECT l_orderkey, list_sort(list(l_linenumber)) = list_sort(list(l_linenumber + CASE WHEN l_partkey % 50 = 0 THEN 1 ELSE 0 END)) AS is_permutation FROM i GROUP BY 1""")
def page_permutations(spark: SparkSession, d: str) -> DataFrame:
    """A recipe's order of pages must have each page once; lists are as long as an order."""
    moved = F.col("l_linenumber") + F.when(F.col("l_partkey") % 50 == 0, 1).otherwise(0)
    orders = _items(spark, d).groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("own"), F.collect_list(moved).alias("asked"))
    return orders.select("l_orderkey", layout.is_permutation(F.col("own"), F.col("asked")).alias("is_permutation"))


@query("""WITH v AS (SELECT doc_id, sha256('{"reader":' || coalesce('"' || lang || '"', 'null') || ',"schema":' || n_chars % 3 || '}') AS now, sha256('{"reader":' || coalesce('"' || lang || '"', 'null') || ',"schema":1}') AS stored FROM documents)
SELECT doc_id, now = stored AS is_current FROM v""")
def pipeline_versions(spark: SparkSession, d: str) -> DataFrame:
    """Drafts were stored by version 1 of the schema."""
    from ..functions.text import fingerprint

    reader = F.col("lang").alias("reader")
    drafts = s.read(spark, d, "documents").withColumn("stored", fingerprint(reader, F.lit(1).alias("schema")))
    return layout.current_pipeline(drafts, [reader, (F.col("n_chars") % 3).alias("schema")], "stored").select("doc_id", "is_current")
