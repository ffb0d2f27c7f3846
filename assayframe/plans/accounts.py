"""Ledgers, periods and jobs over the driver's tables: events are ledger entries, users accounts, orders subscriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import ledger, summaries
from . import standins as s
from .registry import Registry

_own = Registry()
query, QUERIES, ORACLES = _own.query, _own.queries, _own.oracles

NOW = "2024-01-20 00:00:00"


KINDS = ["pages", "minutes"]


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    """signup grants for half a year, view reserves, click releases a job or a grant, purchase consumes; jobs are eight events, half of the entries name their grant. Errors are grants without end."""
    e, i = s.events(spark, d), F.col("event_id")
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), (i % 2).cast("int"))
    entry = F.when(F.col("event_type").isin("signup", "error"), "grant").when(F.col("event_type") == "view", "reserve").when(F.col("event_type") == "click", "release").otherwise("consume")
    month = F.date_trunc("month", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    job, grant = F.concat(F.lit("job-"), F.floor(i / 8).cast("string")), F.concat(F.lit("grant:t"), (i % 50).cast("string"), F.lit(":"), i.cast("string"))
    other = F.concat(F.lit("grant:t"), (i % 50).cast("string"), F.lit(":"), (i - i % 40).cast("string"))
    return e.select(
        F.col("user_id").alias("account_id"), i.alias("ordinal"), kind.alias("kind"), entry.alias("entry_type"), (i % 9 + 1).alias("units"), F.when(entry == "grant", grant).when((entry == "release") & (i % 10 == 0), other).otherwise(job).alias("source_id"),
        F.when((entry != "grant") & (i % 3 == 0), other).alias("grant_source_id"), F.when(i % 7 != 0, month).alias("period_start"), F.when(F.col("event_type") != "error", F.make_timestamp_ntz(F.lit(2024), F.lit(1) + (i % 4).cast("int"), F.lit(15), F.lit(0), F.lit(0), F.lit(0.0))).alias("period_end"),
    )


def _purchases(spark: SparkSession, d: str) -> DataFrame:
    """Every event is a purchase of one of 50 transactions; a transaction has several, of which the first counts."""
    i = F.col("event_id")
    plan = F.get(F.array(F.lit("starter_pack"), F.lit("plus"), F.lit("pro")), (i % 3).cast("int"))
    return s.events(spark, d).select(F.col("user_id").alias("account_id"), i.alias("ordinal"), F.concat(F.lit("t"), (i % 50).cast("string")).alias("transaction_id"), plan.alias("plan_id"), (i % 2).alias("product_id"))


def _entitlements(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    of = _purchases(spark, d).join(s.events(spark, d).select(i.alias("ordinal"), "ts"), "ordinal").where("ordinal % 20 = 0")
    status = F.get(F.array(F.lit("active"), F.lit("expired"), F.lit("pending")), (F.floor(F.col("ordinal") / 20) % 3).cast("int"))
    return of.select("account_id", "plan_id", "product_id", status.alias("status"), F.when(F.col("ordinal") % 60 != 0, F.col("ts") + F.expr("interval 10 days")).alias("period_end"))


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return _ledger(spark, d), _purchases(spark, d), _entitlements(spark, d)


_NOW = f"TIMESTAMP '{NOW}'"
_LIVE = f"(period_start IS NULL OR period_start <= {_NOW}) AND (period_end IS NULL OR {_NOW} < period_end)"
LEDGER = f"""ledger AS (SELECT user_id AS account_id, event_id AS ordinal, {KINDS!r}[1 + event_id % 2] AS kind, CASE event_type WHEN 'view' THEN 'reserve' WHEN 'click' THEN 'release' WHEN 'purchase' THEN 'consume' ELSE 'grant' END AS entry_type, event_id % 9 + 1 AS units,
  CASE WHEN event_type IN ('signup', 'error') THEN 'grant:t' || event_id % 50 || ':' || event_id WHEN event_type = 'click' AND event_id % 10 = 0 THEN 'grant:t' || event_id % 50 || ':' || (event_id - event_id % 40) ELSE 'job-' || event_id // 8 END AS source_id,
  CASE WHEN event_type NOT IN ('signup', 'error') AND event_id % 3 = 0 THEN 'grant:t' || event_id % 50 || ':' || (event_id - event_id % 40) END AS grant_source_id, CASE WHEN event_id % 7 <> 0 THEN date_trunc('month', ts)::TIMESTAMP END AS period_start,
  CASE WHEN event_type <> 'error' THEN make_timestamp(2024, 1 + event_id % 4, 15, 0, 0, 0) END AS period_end FROM events),
purchases AS (SELECT user_id AS account_id, event_id AS ordinal, 't' || event_id % 50 AS transaction_id, ['starter_pack', 'plus', 'pro'][1 + event_id % 3] AS plan_id, event_id % 2 AS product_id, ts FROM events),
active AS (SELECT DISTINCT account_id, plan_id, product_id FROM purchases WHERE ordinal % 20 = 0 AND ['active', 'expired', 'pending'][1 + (ordinal // 20) % 3] IN ('active', 'pending') AND (ordinal % 60 = 0 OR ts + INTERVAL 10 DAY > {_NOW})),
granted AS (SELECT l.*, (SELECT arg_min(struct_pack(plan_id := plan_id, product_id := product_id), p.ordinal) FROM purchases p WHERE p.account_id = l.account_id AND starts_with(l.source_id, 'grant:' || p.transaction_id || ':')) AS bought FROM ledger l WHERE entry_type = 'grant' AND {_LIVE}
  AND NOT EXISTS (SELECT 1 FROM ledger r WHERE r.account_id = l.account_id AND r.entry_type = 'release' AND r.source_id = l.source_id)),
grants AS (SELECT g.* FROM granted g JOIN active a ON a.account_id = g.account_id AND a.plan_id = bought.plan_id AND a.product_id = bought.product_id),
used AS (SELECT e.*, g.ordinal AS grant_ordinal FROM ledger e JOIN grants g ON e.account_id = g.account_id AND e.kind = g.kind AND CASE WHEN e.grant_source_id IS NOT NULL THEN e.grant_source_id = g.source_id ELSE e.period_end IS NOT DISTINCT FROM g.period_end END
  WHERE e.entry_type IN ('reserve', 'consume') AND (e.period_start IS NULL OR e.period_start <= {_NOW}) AND (e.period_end IS NULL OR {_NOW} < e.period_end))"""
BALANCES = f"""{LEDGER}, counted AS (SELECT DISTINCT * EXCLUDE grant_ordinal FROM used), consumed AS (SELECT * FROM counted WHERE entry_type = 'consume'),
live AS (SELECT * FROM counted c WHERE entry_type = 'reserve' AND NOT EXISTS (SELECT 1 FROM ledger r WHERE r.account_id = c.account_id AND r.entry_type = 'release' AND r.source_id = c.source_id) AND NOT EXISTS (SELECT 1 FROM consumed x WHERE x.account_id = c.account_id AND x.kind = c.kind AND x.source_id = c.source_id)),
sums AS (SELECT account_id, kind, coalesce((SELECT sum(units) FROM grants g WHERE g.account_id = k.account_id AND g.kind = k.kind), 0)::BIGINT AS included, coalesce((SELECT sum(units) FROM consumed g WHERE g.account_id = k.account_id AND g.kind = k.kind), 0)::BIGINT AS consumed,
  coalesce((SELECT sum(units) FROM live g WHERE g.account_id = k.account_id AND g.kind = k.kind), 0)::BIGINT AS reserved, (SELECT min(period_end) FROM grants g WHERE g.account_id = k.account_id AND g.kind = k.kind) AS resets_at FROM (SELECT DISTINCT user_id AS account_id, unnest({KINDS!r}) AS kind FROM events) k),
balances AS (SELECT *, greatest(0, included - consumed - reserved)::BIGINT AS remaining FROM sums)"""


def _allowances(spark: SparkSession, d: str) -> DataFrame:
    return ledger.allowances(*_tables(spark, d), s.events(spark, d).select(F.col("user_id").alias("account_id")), KINDS, F.lit(NOW).cast("timestamp_ntz"))


@query(f"WITH {BALANCES} SELECT account_id, kind, included, consumed, reserved, remaining, CAST(resets_at AS VARCHAR) AS resets_at FROM balances")
def ledger_balance(spark: SparkSession, d: str) -> DataFrame:
    return _allowances(spark, d).select("account_id", "kind", "included", "consumed", "reserved", "remaining", F.col("resets_at").cast("string").alias("resets_at"))


@query(f"""WITH {BALANCES} SELECT account_id, kind, CASE WHEN remaining <= 0 OR included <= 0 THEN 'exhausted' WHEN (included - remaining) / included >= 0.95 THEN 'critical' WHEN (included - remaining) / included >= 0.8 THEN 'near-limit' ELSE 'normal' END AS warning FROM balances""")
def ledger_warning(spark: SparkSession, d: str) -> DataFrame:
    return _allowances(spark, d).select("account_id", "kind", "warning")


_OPEN = f"""{LEDGER}, spent AS (SELECT account_id, kind, grant_ordinal, sum(units) AS spent FROM used u WHERE entry_type = 'consume' OR NOT EXISTS (SELECT 1 FROM ledger r WHERE r.account_id = u.account_id AND r.kind = u.kind AND r.entry_type IN ('release', 'consume') AND r.source_id = u.source_id) GROUP BY ALL),
left_over AS (SELECT g.account_id, g.kind, g.source_id, g.ordinal, bought.plan_id AS plan_id, g.period_end, (g.units - coalesce(spent, 0))::BIGINT AS remaining FROM grants g LEFT JOIN spent s ON s.account_id = g.account_id AND s.kind = g.kind AND s.grant_ordinal = g.ordinal)"""


@query(f"WITH {_OPEN} SELECT account_id, kind, source_id, plan_id, remaining FROM left_over")
def open_grants(spark: SparkSession, d: str) -> DataFrame:
    return ledger.open_grants(*_tables(spark, d), F.lit(NOW).cast("timestamp_ntz")).select("account_id", "kind", "source_id", "plan_id", "remaining")


@query(f"""WITH {_OPEN} SELECT account_id, kind, source_id, remaining FROM left_over WHERE remaining > 0
QUALIFY row_number() OVER (PARTITION BY account_id, kind ORDER BY plan_id <> 'starter_pack', coalesce(CAST(period_end AS VARCHAR), ''), ordinal) = 1""")
def grant_pick(spark: SparkSession, d: str) -> DataFrame:
    return ledger.next_grant(ledger.open_grants(*_tables(spark, d), F.lit(NOW).cast("timestamp_ntz")))


@query("""WITH RECURSIVE p AS (SELECT o_orderkey, o_orderdate AS period_start, o_orderdate + INTERVAL 1 DAY * (o_orderkey % 400) AS period_end FROM orders),
b AS (SELECT o_orderkey, 0 AS bucket, period_start AS bucket_start, CASE WHEN date_diff('day', period_start, period_end) > 45 THEN least(period_start + INTERVAL 1 MONTH, period_end) ELSE period_end END AS bucket_end, period_end FROM p
  UNION ALL SELECT o_orderkey, bucket + 1, bucket_end, least(bucket_end + INTERVAL 1 MONTH, period_end), period_end FROM b WHERE bucket_end < period_end AND bucket < 23)
SELECT o_orderkey, bucket, CAST(CAST(bucket_start AS DATE) AS VARCHAR) AS bucket_start, CAST(CAST(bucket_end AS DATE) AS VARCHAR) AS bucket_end FROM b""")
def subscription_buckets(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("o_orderdate").cast("timestamp")
    p = s.read(spark, d, "orders").select("o_orderkey", start.alias("period_start"), (start + F.make_interval(days=(F.col("o_orderkey") % 400).cast("int"))).alias("period_end"))
    return summaries.month_buckets(p, ["o_orderkey"]).select("o_orderkey", "bucket", F.to_date("bucket_start").cast("string").alias("bucket_start"), F.to_date("bucket_end").cast("string").alias("bucket_end"))


@query("""SELECT l_linenumber AS attempt, CAST(least(30000, 1000 * pow(2, least(l_linenumber - 1, 30))) AS BIGINT) AS delay_ms, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def retry_delays(spark: SparkSession, d: str) -> DataFrame:
    delay = dates.retry_delay_ms(F.col("l_linenumber"))
    return s.read(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("attempt"), delay.alias("delay_ms")).agg(F.count("*").alias("n"))


@query("""WITH j AS (SELECT event_id AS job_id, user_id AS owner, CASE WHEN event_type = 'view' THEN 'ready' WHEN event_type = 'click' THEN 'leased' ELSE 'done' END AS state, ts AS available_at, ts + INTERVAL 1 DAY AS expires_at FROM events)
SELECT count(CASE WHEN state = 'ready' AND available_at <= TIMESTAMP '2024-01-20' THEN 1 END) AS n_claimable, count(CASE WHEN state = 'leased' AND expires_at > TIMESTAMP '2024-01-20' THEN 1 END) AS n_live,
  count(CASE WHEN state = 'leased' AND expires_at <= TIMESTAMP '2024-01-20' THEN 1 END) AS n_expired, arg_min(CASE WHEN state = 'ready' THEN job_id END, available_at) AS next_job FROM j""")
def queue_metrics(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    state = F.when(F.col("event_type") == "view", "ready").when(F.col("event_type") == "click", "leased").otherwise("done")
    j = s.events(spark, d).select(F.col("event_id").alias("job_id"), state.alias("state"), F.col("ts").alias("available_at"), (F.col("ts") + F.expr("interval 1 day")).alias("expires_at"))
    leased = F.col("state") == "leased"
    return j.agg(
        summaries.count_if((F.col("state") == "ready") & (F.col("available_at") <= now)).alias("n_claimable"), summaries.count_if(leased & (F.col("expires_at") > now)).alias("n_live"),
        summaries.count_if(leased & (F.col("expires_at") <= now)).alias("n_expired"), F.min_by("job_id", F.when(F.col("state") == "ready", F.col("available_at"))).alias("next_job"),
    )


@query("""WITH c AS (SELECT n_nationkey AS k, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1), p AS (SELECT s_nationkey AS k, count(*) * 5 AS n_planned FROM supplier GROUP BY 1)
SELECT k, n, greatest(0, n - coalesce(n_planned, 0)) AS "left" FROM c LEFT JOIN p USING (k)""")
def counts_less_planned(spark: SparkSession, d: str) -> DataFrame:
    nation = s.read(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    counts = summaries.zero_filled(nation, s.read(spark, d, "customer").select(F.col("c_nationkey").alias("k")), "k")
    planned = s.read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg((F.count("*") * 5).alias("n_planned"))
    return summaries.less_planned(counts, planned, "k").select("k", "n", "left")


@query("""SELECT o_orderkey, CAST(CAST(o_orderdate + INTERVAL 30 DAY + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS next_month, CAST(CAST(o_orderdate - INTERVAL 5 HOUR AS DATE) AS VARCHAR) AS local_day FROM orders""")
def calendar_steps(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp")
    day = dates.add_month(at + F.expr("interval 30 days"))
    local = dates.local_day(F.to_timestamp(F.col("o_orderdate").cast("string")), F.lit("-05:00"))
    return s.read(spark, d, "orders").select("o_orderkey", F.to_date(day).cast("string").alias("next_month"), local.cast("string").alias("local_day"))


@query("SELECT DISTINCT o_orderpriority AS version FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def unsupported_versions(spark: SparkSession, d: str) -> DataFrame:
    return s.read(spark, d, "orders").where((F.col("o_orderstatus") == "O") & ~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(F.col("o_orderpriority").alias("version")).distinct()
