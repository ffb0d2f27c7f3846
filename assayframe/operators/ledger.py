"""Allowances of accounts: which grants count, what has been used of them, what is left and where the next use draws from.

ledger: account_id, ordinal (the order of entries), kind, entry_type (grant, reserve, release, consume), units, source_id, grant_source_id, period_start, period_end.
purchases: account_id, ordinal, transaction_id, plan_id, product_id. entitlements: account_id, plan_id, product_id, status, period_end. A period has its start and not
its end; a null bound is open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import in_period
from .summaries import usage_warning

ACTIVE = ["active", "pending"]
STARTER = "starter_pack"


def valid_grants(ledger: DataFrame, purchases: DataFrame, entitlements: DataFrame, now: Column) -> DataFrame:
    """The grants of the ledger, with plan_id, that are in their period, not released, and bought for a product the account is entitled to.

    A grant's source is `grant:<transaction>:...`; of several purchases with that transaction the first counts.
    """
    released = ledger.where("entry_type = 'release'").select("account_id", "source_id").distinct()
    granted = ledger.where((F.col("entry_type") == "grant") & in_period(now, F.col("period_start"), F.col("period_end"))).join(released, ["account_id", "source_id"], "left_anti")
    bought = purchases.groupBy("account_id", "transaction_id").agg(F.min_by(F.struct("plan_id", "product_id"), "ordinal").alias("bought"))
    with_id = granted.withColumn("transaction_id", F.regexp_extract(F.coalesce("grant_source_id", "source_id"), "^grant:([^:]+):", 1))
    active = entitlements.where(F.col("status").isin(ACTIVE) & (F.col("period_end").isNull() | (F.col("period_end") > now))).select("account_id", "plan_id", "product_id").distinct()
    found = with_id.join(bought, ["account_id", "transaction_id"]).select(*ledger.columns, "bought.*")
    return found.join(active, ["account_id", "plan_id", "product_id"], "left_semi").select(*ledger.columns, "plan_id")


def used_of(ledger: DataFrame, grants: DataFrame, now: Column) -> DataFrame:
    """(entry..., grant_ordinal): consume and reserve entries in their period with each grant of their kind they belong to: the one they name, or else all that end with their period.

    Two equi-joins, one for entries that name a grant and one for those that don't.
    """
    entries = ledger.where(F.col("entry_type").isin("consume", "reserve") & in_period(now, F.col("period_start"), F.col("period_end")))
    g = grants.select("account_id", "kind", F.col("ordinal").alias("grant_ordinal"), F.col("source_id").alias("_source"), F.col("period_end").alias("_end"))
    same = (entries["account_id"] == g["account_id"]) & (entries["kind"] == g["kind"])
    named = entries.join(g, same & (entries["grant_source_id"] == g["_source"]))
    timed = entries.where("grant_source_id is null").join(g, same & entries["period_end"].eqNullSafe(g["_end"]))
    columns = [entries[c] for c in ledger.columns]
    return named.select(*columns, "grant_ordinal").unionByName(timed.select(*columns, "grant_ordinal"))


def allowances(ledger: DataFrame, purchases: DataFrame, entitlements: DataFrame, accounts: DataFrame, kinds: list[str], now: Column) -> DataFrame:
    """(account_id, kind, included, consumed, reserved, remaining, warning, resets_at) for every account and kind.

    Only entries that belong to a valid grant count, each once. A reservation counts until its source is released or one of the counted consume entries has it.
    """
    grants = valid_grants(ledger, purchases, entitlements, now)
    keys = ["account_id", "kind"]
    counted = used_of(ledger, grants, now).select(*ledger.columns).distinct()
    released = ledger.where("entry_type = 'release'").select("account_id", "source_id").distinct()
    consumed = counted.where("entry_type = 'consume'")
    live = counted.where("entry_type = 'reserve'").join(released, ["account_id", "source_id"], "left_anti").join(consumed.select(*keys, "source_id").distinct(), [*keys, "source_id"], "left_anti")
    every = accounts.select("account_id").distinct().withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds])))
    total = lambda df, name: df.groupBy(*keys).agg(F.sum("units").alias(name))
    included = grants.groupBy(*keys).agg(F.sum("units").alias("included"), F.min("period_end").alias("resets_at"))
    sums = every.join(included, keys, "left").join(total(consumed, "consumed"), keys, "left").join(total(live, "reserved"), keys, "left").na.fill(0, ["included", "consumed", "reserved"])
    left = sums.withColumn("remaining", F.greatest(F.lit(0).cast("long"), F.col("included") - F.col("consumed") - F.col("reserved")))
    return left.withColumn("warning", usage_warning(F.col("remaining"), F.col("included"))).select(*keys, "included", "consumed", "reserved", "remaining", "warning", "resets_at")


def open_grants(ledger: DataFrame, purchases: DataFrame, entitlements: DataFrame, now: Column) -> DataFrame:
    """The valid grants with `remaining`: units less what was consumed and is reserved of each. A reservation ends with any release or consume entry of its kind and source."""
    grants = valid_grants(ledger, purchases, entitlements, now)
    settled = ledger.where(F.col("entry_type").isin("release", "consume")).select("account_id", "kind", "source_id").distinct()
    used = used_of(ledger, grants, now)
    live = used.where("entry_type = 'reserve'").join(settled, ["account_id", "kind", "source_id"], "left_anti").select("account_id", "kind", "grant_ordinal", "units")
    spent = used.where("entry_type = 'consume'").select("account_id", "kind", "grant_ordinal", "units").unionByName(live).groupBy("account_id", "kind", "grant_ordinal").agg(F.sum("units").alias("spent"))
    with_spent = grants.withColumn("grant_ordinal", F.col("ordinal")).join(spent, ["account_id", "kind", "grant_ordinal"], "left")
    return with_spent.withColumn("remaining", F.col("units") - F.coalesce("spent", F.lit(0))).drop("spent", "grant_ordinal")


def next_grant(grants: DataFrame) -> DataFrame:
    """(account_id, kind, source_id, remaining) of the grant to draw from: with units left, starter packs first, then the earliest end, an open end before all, then the ledger's order."""
    order = F.struct((F.col("plan_id") != STARTER).alias("late"), F.coalesce(F.col("period_end").cast("string"), F.lit("")).alias("end"), "ordinal")
    picked = grants.where("remaining > 0").groupBy("account_id", "kind").agg(F.min_by(F.struct("source_id", "remaining"), order).alias("g"))
    return picked.select("account_id", "kind", "g.*")
