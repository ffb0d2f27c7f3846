"""Parsing, folding and output of values, over fixed cases and tokens of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, geometry, numbers, text
from ..sources import readers
from . import standins as s
from .registry import Registry

_own = Registry()
query, QUERIES, ORACLES = _own.query, _own.queries, _own.oracles


def _literal(v: str | None) -> str:
    return "(NULL)" if v is None else "('" + v.replace("'", "''") + "')"


def _tokens(spark: SparkSession, d: str, cases: list[str | None]) -> DataFrame:
    """(x, n): every different token of documents and every case, with how often it occurs."""
    words = s.read(spark, d, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), "[ \t\n\r]+")).alias("x"))
    return words.unionAll(spark.createDataFrame([(c,) for c in cases], "x string")).groupBy("x").agg(F.count("*").alias("n"))


def _tokens_sql(cases: list[str | None]) -> str:
    return f"t AS (SELECT x, count(*) AS n FROM (SELECT unnest(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r]+')) AS x FROM documents UNION ALL SELECT x FROM (VALUES {', '.join(map(_literal, cases))}) v(x)) GROUP BY 1)"


def _decimal_sql(x: str) -> str:
    """The number that the text of the SQL expression x says: spaces go, of comma and dot the last is the sign, a lone comma too."""
    t = f"regexp_replace({x}, '[\\s\\x{{0b}}\\x{{a0}}\\x{{202f}}]', '', 'g')"
    plain = f"CASE WHEN contains({t}, ',') AND contains({t}, '.') THEN CASE WHEN strpos(reverse({t}), ',') < strpos(reverse({t}), '.') THEN regexp_replace(replace({t}, '.', ''), ',', '.') ELSE replace({t}, ',', '') END WHEN contains({t}, ',') THEN regexp_replace({t}, ',', '.') ELSE {t} END"
    return f"(SELECT CASE WHEN regexp_full_match(p, '[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN TRY_CAST(ltrim(p, '+') AS DOUBLE) END FROM (SELECT {plain} AS p))"


DECIMALS = ["1", " 2.5 ", "3,5", "1.234,5", "1,234.5", "1 234", "-7", "+.5", "4.", "1.2.3", "1,2,3", "abc", "", "12e3", "1.234.567,8", None]


@query(f"WITH {_tokens_sql(DECIMALS)} SELECT x, n, {_decimal_sql('x')} AS num FROM t")
def parse_decimal(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d, DECIMALS).select("x", "n", numbers.locale_decimal(F.col("x")).alias("num"))


COMPARATORS = ["<5", "> 3,5", "≤ 7", "≥2.5 mg", "12 mg/dL", "negative", "", "  ", "-4", "<", "5 - 7", "1.2.3", "<1,234.5", None]
_SHAPE = r"^([<>≤≥])?\s*([+-]?(?:[0-9][0-9\s\x{a0}\x{202f}.,]*|\.[0-9]+))\s*(.*)$"


@query(f"""WITH {_tokens_sql(COMPARATORS)}, m AS (SELECT x, n, trim(x) AS t, regexp_extract(trim(x), '{_SHAPE}', 1) AS sign, regexp_extract(trim(x), '{_SHAPE}', 2) AS number FROM t), v AS (SELECT *, {_decimal_sql('number')} AS num, CASE WHEN sign IN ('<', '≤') THEN '<' WHEN sign IN ('>', '≥') THEN '>' END AS bound FROM m)
SELECT x, n, CASE WHEN t <> '' THEN CASE WHEN num IS NULL THEN 'free_text' WHEN bound IS NOT NULL THEN 'bounded' ELSE 'numeric' END END AS kind, CASE WHEN num IS NOT NULL THEN bound END AS comparator, num, CASE WHEN num IS NULL AND t <> '' THEN t END AS text FROM v""")
def parse_comparator(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d, COMPARATORS).withColumn("v", numbers.comparator_value(F.col("x"))).select("x", "n", "v.kind", "v.comparator", "v.num", "v.text")


SCALARS = ["<=5", "≤ 5", "=4,5", "12", "Negative", "negative", "see note", "a. b", "", "≥ -3.25", "> ", None]


@query(f"""WITH {_tokens_sql(SCALARS)}, r AS (SELECT x, n, CASE WHEN length(x) % 2 = 0 THEN ' ' || lower(x) WHEN length(x) % 3 = 0 THEN 'negative' END AS ref, trim(regexp_replace(x, '[\\s\\x{{0b}}]+', ' ', 'g')) AS c, regexp_replace(x, '[\\s\\x{{0b}}]+', '', 'g') AS k FROM t),
m AS (SELECT *, nullif(regexp_extract(k, '^(<=|>=|<|>|≤|≥|=)?([+-]?[0-9]+(?:[.,][0-9]+)?)$', 1), '') AS sign, TRY_CAST(replace(regexp_extract(k, '^(<=|>=|<|>|≤|≥|=)?([+-]?[0-9]+(?:[.,][0-9]+)?)$', 2), ',', '.') AS DOUBLE) AS num FROM r)
SELECT x, n, ref, CASE WHEN c = '' OR c IS NULL THEN NULL WHEN num IS NOT NULL AND sign IS NULL THEN 'numeric' WHEN num IS NOT NULL THEN 'bounded' WHEN coalesce(lower(trim(ref)) = lower(c), false) AND NOT regexp_matches(c, '[.!?;]') THEN 'categorical' ELSE 'text' END AS kind,
  CASE WHEN num IS NOT NULL THEN CASE sign WHEN '≤' THEN '<=' WHEN '≥' THEN '>=' ELSE sign END END AS comparator, num, CASE WHEN num IS NULL AND c <> '' THEN c END AS text FROM m""")
def parse_scalar(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    rows = _tokens(spark, d, SCALARS).withColumn("ref", F.when(F.length(x) % 2 == 0, F.concat(F.lit(" "), F.lower(x))).when(F.length(x) % 3 == 0, "negative"))
    return rows.withColumn("v", numbers.scalar_value(x, F.col("ref"))).select("x", "n", "ref", "v.kind", "v.comparator", "v.num", "v.text")


INTERVALS = ["70-99", " 3.5 – 5 ", "<5", "4 to 6", "70-", "abc", "", "≥ 3", "1,5-2,5 mg", "70 - <99", "4 TO 6", None]
_NUM = r"[+-]?(?:[0-9][0-9\s\x{a0}\x{202f}.,]*|\.[0-9]+)"


@query(f"""WITH {_tokens_sql(INTERVALS)} SELECT x, n, CASE WHEN regexp_full_match(trim(x), '(?i)(?:[<>≤≥]\\s*)?{_NUM}(?:\\s*(?:-|–|—|to)\\s*[<>≤≥]?\\s*{_NUM})?') THEN trim(x) END AS y FROM t""")
def parse_interval(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d, INTERVALS).select("x", "n", numbers.reference_interval(F.col("x")).alias("y"))


UNITS = ["mg / dl", "MMOL/L", "μg/L", "ug/l", "U/l", "cells  per  µL", "%", "", "fl", "Mg Dl", None]


@query(f"""WITH {_tokens_sql(UNITS)}, c AS (SELECT x, n, regexp_replace(regexp_replace(replace(trim(x), 'μ', 'µ'), '\\s*/\\s*', '/', 'g'), '\\s+', ' ', 'g') AS neat FROM t)
SELECT x, n, nullif(CASE lower(neat) {" ".join(f"WHEN '{low}' THEN '{usual}'" for low, usual in numbers.UNIT_SPELLINGS.items())} ELSE neat END, '') AS unit, lower(regexp_replace(x, '[\\s\\x{{0b}}]+', '', 'g')) AS unit_key FROM c""")
def normalize_unit(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d, UNITS).select("x", "n", numbers.unit(F.col("x")).alias("unit"), numbers.unit_key(F.col("x")).alias("unit_key"))


DATES = ["2024-02-30", "2024-02-29", "13/02/2024", "02/13/2024", "03/04/2024", "3.4.24", "3.4.2024", "abc", "", "31.12.1999", "1/2", "1-2-3-4", "0.0.0", "2024-13-01", None]
LOCALES = ["en-US", "de-DE", "fr-FR", "lt-LT"]
_DAYS = ["yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy", "d.M.yy", "dd/MM/yyyy", "d-M-yyyy"]
_DAYS_SQL = ["%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y", "%-d.%-m.%y", "%d/%m/%Y", "%-d-%-m-%Y"]


def _dates_sql() -> str:
    of = lambda y, m, day: f"TRY_CAST(CASE WHEN {y} BETWEEN 1 AND 9999 THEN printf('%04d-%02d-%02d', {y}, {m}, {day}) END AS DATE)"
    full = lambda y, m, day: of(f"(CASE WHEN {y} < 100 THEN {y} + 2000 ELSE {y} END)", m, day)
    whole = "len(p) = 3 AND a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL"
    us = "regexp_matches(locale, '^en-(?:US|CA)')"
    number = lambda i: f"CASE WHEN regexp_full_match(trim(p[{i}]), '[+-]?[0-9]+') THEN TRY_CAST(trim(p[{i}]) AS INTEGER) END"
    part = lambda i: f"TRY_CAST(regexp_extract(x, '([0-9]{{1,4}})[./-]([0-9]{{1,2}})[./-]([0-9]{{1,4}})', {i}) AS INTEGER)"
    return f"""{_tokens_sql(DATES)}, o AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), w AS (SELECT x, n FROM t UNION ALL SELECT unnest([{", ".join(f"strftime(day, '{f}')" for f in _DAYS_SQL)}]), n FROM o),
g AS (SELECT x, sum(n)::BIGINT AS n FROM w GROUP BY 1), l AS (SELECT x, n, unnest({LOCALES!r}) AS locale, string_split_regex(trim(x), '[./-]') AS p FROM g), k AS (SELECT *, {number(1)} AS a, {number(2)} AS b, {number(3)} AS c, {part(1)} AS ha, {part(2)} AS hb, {part(3)} AS hc FROM l)
SELECT x, n, locale, CAST(CASE WHEN {whole} THEN CASE WHEN length(CAST(a AS VARCHAR)) = 4 THEN {full("a", "b", "c")} WHEN a > 12 THEN {full("c", "b", "a")} WHEN b > 12 THEN {full("c", "a", "b")} WHEN {us} THEN {full("c", "a", "b")} ELSE {full("c", "b", "a")} END END AS VARCHAR) AS lab,
  CAST(CASE WHEN {whole} THEN CASE WHEN length(CAST(a AS VARCHAR)) = 4 THEN {full("a", "b", "c")} WHEN {us} THEN {full("c", "a", "b")} ELSE {full("c", "b", "a")} END END AS VARCHAR) AS typed,
  CAST(CASE WHEN ha >= 1000 THEN {of("ha", "hb", "hc")} WHEN hc >= 1000 AND contains(x, '/') THEN CASE WHEN locale = 'en-US' THEN {of("hc", "ha", "hb")} WHEN locale IN ('lt-LT', 'de-DE', 'de-CH') THEN {of("hc", "hb", "ha")} END WHEN hc >= 1000 THEN {of("hc", "hb", "ha")} END AS VARCHAR) AS header,
  CAST(CASE WHEN regexp_full_match(x, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN TRY_CAST(x AS DATE) END AS VARCHAR) AS strict, coalesce({whole} AND a <= 12 AND b <= 12 AND length(CAST(a AS VARCHAR)) < 4, false) AS ambiguous FROM k"""


@query(f"WITH {_dates_sql()}")
def parse_date(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of documents and the days of orders in six forms, each read in four locales."""
    x, locale = F.col("x"), F.col("locale")
    days = s.read(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    said = days.select(F.explode(F.array(*[F.date_format("day", f) for f in _DAYS])).alias("x"), "n")
    each = _tokens(spark, d, DATES).unionByName(said).groupBy("x").agg(F.sum("n").alias("n")).withColumn("locale", F.explode(F.array(*[F.lit(v) for v in LOCALES])))
    return each.select("x", "n", "locale", dates.lab_date(x, locale).cast("string").alias("lab"), dates.typed_date(x, locale).cast("string").alias("typed"), dates.header_date(x, locale).cast("string").alias("header"), dates.iso_date(x).cast("string").alias("strict"), F.coalesce(dates.ambiguous_date(x, F.lit(None).cast("string")), F.lit(False)).alias("ambiguous"))


_EN = "January February March April May June July August September October November December".split()
_DE = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split()


@query(f"""WITH o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS t FROM orders), p AS (SELECT t, year(t) AS y, month(t) AS m, day(t) AS d FROM o), f AS (SELECT t, unnest(range(7)) AS form, y, m, d FROM p)
SELECT CAST(t AS VARCHAR) AS t, form, CASE form WHEN 0 THEN d || ' ' || {_EN!r}[m] || ' ' || y WHEN 1 THEN d || '. ' || {_DE!r}[m] || ' ' || y WHEN 2 THEN upper({_EN!r}[m]) || ' ' || d || ', ' || y WHEN 3 THEN 'on ' || d || ' ' || {_DE!r}[m] || ' ' || y || ' at'
  WHEN 4 THEN '30 February ' || y WHEN 5 THEN 'Marzo ' || d || ' ' || y ELSE d || {_EN!r}[m] || y END AS x, CASE WHEN form < 4 THEN CAST(t AS VARCHAR) END AS day FROM f""")
def parse_month_name(spark: SparkSession, d: str) -> DataFrame:
    """The days of orders in seven forms, the last three of which name no day."""
    t = s.read(spark, d, "orders").select(F.to_date("o_orderdate").alias("t")).distinct()
    name = lambda months: F.element_at(F.array(*[F.lit(m) for m in months]), F.month("t"))
    day, year = F.dayofmonth("t").cast("string"), F.year("t").cast("string")
    forms = F.array(
        F.concat_ws(" ", day, name(_EN), year), F.concat(day, F.lit(". "), name(_DE), F.lit(" "), year), F.concat(F.upper(name(_EN)), F.lit(" "), day, F.lit(", "), year), F.concat_ws(" ", F.lit("on"), day, name(_DE), year, F.lit("at")),
        F.concat(F.lit("30 February "), year), F.concat_ws(" ", F.lit("Marzo"), day, year), F.concat(day, name(_EN), year),
    )
    return t.select("t", F.posexplode(forms).alias("form", "x")).select(F.col("t").cast("string").alias("t"), F.col("form").cast("long").alias("form"), "x", dates.month_name_date(F.col("x")).cast("string").alias("day"))


@query("""SELECT doc_id, trim(regexp_replace(lower(strip_accents(replace(replace(word, 'ß', '?'), 'ẞ', '?'))), '[^a-z0-9]+', ' ', 'g')) AS alias_key FROM (SELECT doc_id, text AS word FROM documents)""")
def normalize_alias(spark: SparkSession, d: str) -> DataFrame:
    return s.read(spark, d, "documents").select("doc_id", text.alias_key(F.col("text")).alias("alias_key"))


@query("""SELECT n_nationkey, CASE WHEN x IS NOT NULL AND ltrim(x)[1] IN ('=', '+', '-', '@') THEN '"' || x[1 : length(x) - length(ltrim(x))] || '''' || replace(ltrim(x), '"', '""') || '"' WHEN x IS NULL THEN 'NULL' ELSE '"' || replace(x, '"', '""') || '"' END AS cell
FROM (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN ['=', '  +', '-', ' @'][1 + n_nationkey % 3] || n_name WHEN 1 THEN n_name || '"x"' WHEN 2 THEN n_name END AS x FROM nation)""")
def csv_cell_neutralise(spark: SparkSession, d: str) -> DataFrame:
    k, name = F.col("n_nationkey") % 4, F.col("n_name")
    mark = F.get(F.array(F.lit("="), F.lit("  +"), F.lit("-"), F.lit(" @")), F.col("n_nationkey") % 3)
    x = F.when(k == 0, F.concat(mark, name)).when(k == 1, F.concat(name, F.lit('"x"'))).when(k == 2, name)
    return s.read(spark, d, "nation").select("n_nationkey", text.csv_cell(x).alias("cell"))


@query("""SELECT n_nationkey, '{"key":' || n_nationkey || ',"name":' || CASE WHEN n_nationkey % 3 = 0 THEN 'null' ELSE '"' || n_name || '"' END || ',"region":' || n_regionkey || '}' AS json FROM nation""")
def canonical_json(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name"))
    return s.read(spark, d, "nation").select("n_nationkey", text.canonical_json(F.col("n_nationkey").alias("key"), name.alias("name"), F.col("n_regionkey").alias("region")).alias("json"))


@query("""SELECT doc_id, sha256(text) AS sha, strlen(text) AS n_bytes, CASE WHEN strlen(text) < 1024 THEN strlen(text) || ' B' WHEN strlen(text) < 1048576 THEN printf('%.1f', round(strlen(text) / 1024, 1)) || ' KB' ELSE printf('%.1f', round(strlen(text) / 1048576, 1)) || ' MB' END AS size FROM documents""")
def sha_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    n = F.octet_length("text").cast("long")
    return s.read(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), n.alias("n_bytes"), text.file_size(n).alias("size"))


@query(f"""WITH {s.MEASUREMENTS} SELECT record_id, measurement_id, CASE kind WHEN 'categorical' THEN flag ELSE CASE kind WHEN 'bounded' THEN '<' ELSE '' END || CASE WHEN line % 2 = 0 THEN CAST(CAST(num AS BIGINT) AS VARCHAR) ELSE CAST(CAST(num AS BIGINT) AS VARCHAR) || '.25' END END AS shown FROM measurements""")
def measurement_texts(spark: SparkSession, d: str) -> DataFrame:
    num = F.col("num") + F.when(F.col("line") % 2 == 0, 0.0).otherwise(0.25)
    return s.measurements(spark, d).select("record_id", "measurement_id", numbers.value_text(F.col("kind"), F.lit("<"), num.cast("double"), F.col("flag")).alias("shown"))


@query("""SELECT p_partkey, round(p_size / 100.0 + 0.4 * (p_partkey % 5) / length(p_name), 9) AS x, round(0.4 * 3 / length(p_name), 9) AS width FROM part""")
def part_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Three characters of a name in the box of the whole."""
    start = F.col("p_partkey") % 5
    box = geometry.part_of_box(F.col("p_size") / 100.0, F.lit(0.4), start, start + 3, F.length("p_name"))
    return s.read(spark, d, "part").select("p_partkey", F.round(box["x"], 9).alias("x"), F.round(box["width"], 9).alias("width"))


@query("""SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 3 = 1""")
def bound_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts of orders of which a third are unchanged, a third changed and a third not expected at all."""
    o, k = s.read(spark, d, "orders"), F.col("o_orderkey")
    made = o.withColumn("digest", F.sha2(F.col("o_orderpriority").cast("binary"), 256))
    expected = o.where(k % 3 != 0).select("o_orderkey", F.sha2(F.when(k % 3 == 1, F.col("o_orderpriority")).otherwise("other").cast("binary"), 256).alias("digest"))
    return readers.bound_to(made, expected, "o_orderkey", "digest").select("o_orderkey", "o_orderpriority")


TOKENS = ["plain", "with space", "a.b-c_D9", "x" * 81, "", "é", "a..b", "-a", None]


@query(f"""WITH {_tokens_sql(TOKENS)} SELECT x, n, CASE WHEN length(x) BETWEEN 1 AND 80 AND translate(lower(x), 'abcdefghijklmnopqrstuvwxyz0123456789._-', '') = '' AND length(x) = strlen(x) THEN x ELSE 'redacted' END AS safe,
  len(list_filter(string_split_regex(x, '[._-]'), lambda p: p = '' OR translate(p, 'abcdefghijklmnopqrstuvwxyz0123456789', '') <> '')) = 0 AS canonical FROM t""")
def safe_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d, TOKENS).select("x", "n", text.safe_token(F.col("x")).alias("safe"), text.is_canonical_id(F.col("x")).alias("canonical"))


_NAMES = {"plasma": "plasma", "serum": "serum|sérum|serumas", "urine": "urine|urin|orina|urina", "blood": "blood|whole blood|blut|vollblut|sang|sangue|bloed|krew|kraujas|kraujo"}
_SAID = ["Serum iron", "Vollblut EDTA", "Serum / Plasma", "kraujas", "Sangue e urina", "URINA", "bloodline", "note", "krew pelna"]


@query(f"""WITH t AS (SELECT doc_id, CAST(i AS INTEGER) AS i, text || ' ' || ['{"', '".join(_SAID)}'][i] AS x FROM documents, range(1, {len(_SAID) + 1}) r(i) UNION ALL SELECT doc_id, 0, text FROM documents),
n AS (SELECT doc_id, i, {", ".join(f"regexp_matches(' ' || lower(coalesce(x, '')) || ' ', '[^a-z0-9_](?:{p})[^a-z0-9_]') AS {k}" for k, p in _NAMES.items())} FROM t)
SELECT doc_id, i, CASE WHEN CAST(plasma AS INT) + CAST(serum AS INT) + CAST(urine AS INT) + CAST(blood AS INT) <> 1 THEN 'unknown' WHEN plasma THEN 'plasma' WHEN serum THEN 'serum' WHEN urine THEN 'urine' ELSE 'blood' END AS specimen FROM n""")
def specimen_from_text(spark: SparkSession, d: str) -> DataFrame:
    docs = s.read(spark, d, "documents")
    said = F.array(F.lit(""), *[F.lit(f" {x}") for x in _SAID])
    each = docs.select("doc_id", "text", F.posexplode(said).alias("i", "more")).withColumn("x", F.concat("text", "more"))
    return each.select("doc_id", "i", text.specimen(F.col("x")).alias("specimen"))


@query("""WITH v AS (SELECT p_partkey, p_partkey % 3 || '.' || p_size || '.' || p_partkey % 12 || CASE WHEN p_partkey % 7 = 0 THEN '-rc.1' ELSE '' END AS a, p_partkey % 2 || '.' || (p_size + p_partkey) % 50 || '.' || p_partkey % 11 AS b, [p_partkey % 3, p_size, p_partkey % 12] AS la, [p_partkey % 2, (p_size + p_partkey) % 50, p_partkey % 11] AS lb FROM part)
SELECT p_partkey, a, b, la[1] < lb[1] OR (la[1] = lb[1] AND (la[2] < lb[2] OR (la[2] = lb[2] AND la[3] < lb[3]))) AS older FROM v""")
def version_order(spark: SparkSession, d: str) -> DataFrame:
    k, size, t = F.col("p_partkey"), F.col("p_size"), lambda c: c.cast("string")
    a = F.concat(F.concat_ws(".", t(k % 3), t(size), t(k % 12)), F.when(k % 7 == 0, "-rc.1").otherwise(""))
    v = s.read(spark, d, "part").select("p_partkey", a.alias("a"), F.concat_ws(".", t(k % 2), t((size + k) % 50), t(k % 11)).alias("b"))
    return v.select("p_partkey", "a", "b", (text.version_triple(F.col("a")) < text.version_triple(F.col("b"))).alias("older"))


@query("""SELECT p_partkey, round(greatest(0, least((p_size + 10) / 60.0, 0.6) - greatest(p_size / 60.0, 0.3)), 9) AS shared, round(greatest(0, greatest(p_size / 60.0, 0.3) - least((p_size + 10) / 60.0, 0.6)), 9) AS apart,
  round(greatest(0.2, least(0.45, 8 * p_size / 1000.0)), 9) AS reach FROM part""")
def box_overlap(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("p_size") / 60.0, (F.col("p_size") + 10) / 60.0
    return s.read(spark, d, "part").select("p_partkey", F.round(geometry.overlap(a, b, F.lit(0.3), F.lit(0.6)), 9).alias("shared"), F.round(geometry.gap(a, b, F.lit(0.3), F.lit(0.6)), 9).alias("apart"), F.round(geometry.continuity_gap(F.col("p_size") / 1000.0), 9).alias("reach"))


@query("""SELECT p_brand, round(min(x), 9) AS x, round(min(y), 9) AS y, round(max(x + w) - min(x), 9) AS width, round(max(y + h) - min(y), 9) AS height FROM (SELECT p_brand, p_size / 100.0 AS x, p_partkey % 50 / 100.0 AS y, 0.1 AS w, 0.02 AS h FROM part) GROUP BY 1""")
def union_boxes(spark: SparkSession, d: str) -> DataFrame:
    box = s.read(spark, d, "part").groupBy("p_brand").agg(*geometry.union_box(F.col("p_size") / 100.0, F.col("p_partkey") % 50 / 100.0, F.lit(0.1), F.lit(0.02)))
    return box.select("p_brand", *[F.round(c, 9).alias(c) for c in ("x", "y", "width", "height")])


@query("""SELECT p_partkey, unnest([0, 90, 180, 270]) AS turn, round(unnest([x, 1 - y - 0.1, 1 - x - 0.2, y]), 9) AS x, round(unnest([y, x, 1 - y - 0.1, 1 - x - 0.2]), 9) AS y FROM (SELECT p_partkey, p_size / 100.0 AS x, p_partkey % 50 / 100.0 AS y FROM part)""")
def turned_boxes(spark: SparkSession, d: str) -> DataFrame:
    rows = s.read(spark, d, "part").select("p_partkey", (F.col("p_size") / 100.0).alias("x"), (F.col("p_partkey") % 50 / 100.0).alias("y"), F.explode(F.array(*[F.lit(t) for t in (0, 90, 180, 270)])).alias("turn"))
    box = geometry.turned(F.col("x"), F.col("y"), F.lit(0.2), F.lit(0.1), F.col("turn"))
    return rows.withColumn("b", box).select("p_partkey", "turn", F.round("b.x", 9).alias("x"), F.round("b.y", 9).alias("y"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '(\pL)(\pN)', '\1 \2', 'g'), '[^\pL\pN]+', ' ', 'g')) AS header_key FROM documents""")
def header_keys(spark: SparkSession, d: str) -> DataFrame:
    return s.read(spark, d, "documents").select("doc_id", text.header_key(F.col("text")).alias("header_key"))


_ENDS = "CASE p_size % 7 WHEN 0 THEN ' not detected' WHEN 1 THEN ' Negative ' WHEN 2 THEN ' nicht nachgewiesen' WHEN 3 THEN ' UNAUFFÄLLIG' WHEN 4 THEN ' present' WHEN 5 THEN 'positive' ELSE '' END"
_LIST = lambda values: "('" + "', '".join(values) + "')"


@query(f"""WITH x AS (SELECT p_partkey, p_name || {_ENDS} AS line, {_ENDS} AS cell FROM part)
SELECT p_partkey, nullif(regexp_extract(line, '(?i)(?:^|\\s)({"|".join(text.CORE_RESULTS)})\\s*$', 1), '') AS suffix, lower(trim(cell)) IN {_LIST(text.CORE_RESULTS + text.CELL_RESULTS)} AS qualitative FROM x""")
def qualitative_results(spark: SparkSession, d: str) -> DataFrame:
    x = s.read(spark, d, "part").select("p_partkey", F.expr(f"concat(p_name, {_ENDS})").alias("line"), F.expr(_ENDS).alias("cell"))
    return x.select("p_partkey", text.qualitative_suffix(F.col("line")).alias("suffix"), text.is_qualitative(F.col("cell")).alias("qualitative"))
