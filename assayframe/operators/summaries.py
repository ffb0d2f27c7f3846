"""Summaries of records, reports and confirmations: conditional aggregation in one pass, combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def record_summary(measurements: DataFrame, key: str, flagged: Column, comparable: Column) -> DataFrame:
    """Per record: results, flagged ones, comparable ones, and those preserved only."""
    return measurements.groupBy(key).agg(F.count("*").alias("n_results"), count_if(flagged).alias("n_flagged"), count_if(comparable).alias("n_comparable"), count_if(~comparable).alias("n_preserved"))


def parent_summary(parents: DataFrame, children: DataFrame, key: str, date: str, count: str) -> DataFrame:
    """Each parent with the latest known date and the sum of `count` of its children; zero and null if it has none."""
    agg = children.groupBy(key).agg(F.max(date).alias("latest_date"), F.sum(count).alias("n_results"))
    return parents.join(agg, key, "left").withColumn("n_results", F.coalesce("n_results", F.lit(0)))


def entries_with_label(measurements: DataFrame, key: str, label: str, order: list[str]) -> DataFrame:
    """Per key the number of rows, and the label of the last one in `order`."""
    return measurements.groupBy(key).agg(F.count("*").alias("n_results"), F.max_by(label, F.struct(*order)).alias("label"))


def confirmation_groups(rows: DataFrame, keys: dict[str, Column], order: Column, blocking: Column) -> DataFrame:
    """Groups in the order of their first row: keys (null dates as `missing`), first_row, n_rows, n_blocking, can_confirm."""
    named = [c.alias(n) for n, c in keys.items()]
    out = rows.groupBy(*named).agg(F.min(order).alias("first_row"), F.count("*").alias("n_rows"), count_if(blocking).alias("n_blocking"))
    return out.withColumn("can_confirm", F.col("n_blocking") == 0)


def totals(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: how many rows of df meet each condition."""
    return df.agg(*[count_if(c).alias(n) for n, c in conditions.items()])


def zero_filled(codes: DataFrame, found: DataFrame, key: str, count: str = "n") -> DataFrame:
    """Every code of the dimension with its number of rows in found, zero included."""
    counted = found.groupBy(key).agg(F.count("*").alias(count))
    return codes.join(counted, key, "left").withColumn(count, F.coalesce(count, F.lit(0)))


def nearest_rank(values: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles that are values themselves: the ceil(n * p)-th smallest."""
    return values.groupBy(*keys).agg(*[F.expr(f"percentile_disc({p}) within group (order by {value})").alias(name) for name, p in shares.items()])


def upper_median(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value at index floor(n / 2) of the sorted values: of an even number, the upper of the two in the middle.

    Two passes, counts by value and a running sum, so that no group is gathered into one array.
    """
    from pyspark.sql import Window

    counts = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(value)
    reached = counts.withColumn("_up_to", F.sum("_n").over(w)).withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
    return reached.where(F.col("_up_to") > F.floor(F.col("_total") / 2)).groupBy(*keys).agg(F.min(value).alias("upper_median"))


def merged_counters(maps: DataFrame, keys: list[str], counts: str) -> DataFrame:
    """(keys, counter, total): maps of counters added up."""
    return maps.select(*keys, F.explode(counts).alias("counter", "n")).groupBy(*keys, "counter").agg(F.sum("n").alias("total"))


def less_planned(counts: DataFrame, planned: DataFrame, key: str) -> DataFrame:
    """Counts minus what a plan will delete, never below zero."""
    return counts.join(planned, key, "left").withColumn("left", F.greatest(F.lit(0), F.col("n") - F.coalesce("n_planned", F.lit(0))))


def usage_warning(remaining: Column, included: Column) -> Column:
    used = (included - remaining) / F.nullif(included, F.lit(0))
    return F.when((remaining <= 0) | (included <= 0), "exhausted").when(used >= 0.95, "critical").when(used >= 0.8, "near-limit").otherwise("normal")


def month_buckets(subscriptions: DataFrame, keys: list[str], limit: int = 24) -> DataFrame:
    """Periods of over 45 days as months, each beginning where the last ended (so an end of month drifts down), the last one clipped."""
    step = F.struct(F.lit(0).alias("n"), F.col("period_start").alias("at"), F.array().cast("array<struct<n:int,start:timestamp,end:timestamp>>").alias("done"))

    def grow(acc: Column, i: Column) -> Column:
        end = F.least(acc["at"] + F.make_interval(months=F.lit(1)), F.col("period_end"))
        more = acc["at"] < F.col("period_end")
        return F.struct((acc["n"] + 1).alias("n"), F.when(more, end).otherwise(acc["at"]).alias("at"), F.when(more, F.array_append(acc["done"], F.struct(acc["n"].alias("n"), acc["at"].alias("start"), end.alias("end")))).otherwise(acc["done"]).alias("done"))

    monthly = F.aggregate(F.sequence(F.lit(1), F.lit(limit)), step, grow, lambda acc: acc["done"])
    whole = F.array(F.struct(F.lit(0).alias("n"), F.col("period_start").alias("start"), F.col("period_end").alias("end")))
    days = F.datediff("period_end", "period_start")
    return subscriptions.withColumn("b", F.explode(F.when(days > 45, monthly).otherwise(whole))).select(*keys, F.col("b.n").alias("bucket"), F.col("b.start").alias("bucket_start"), F.col("b.end").alias("bucket_end"))
