"""Scans in a total order, children of parents, predicates over states, and picks of first rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def durable(df: DataFrame) -> DataFrame:
    """df computed once into `spark.checkpoint.dir`, the folder that all executors share; a local one only where all executors are on this machine."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """df with the number, from 1, of each row in a total order of the whole table.

    No task sees all rows: they are dealt into ranges of the order, stored once (ranges are sampled, so a second run could deal them otherwise), numbered
    inside each range, and moved on by the sizes of the ranges before, of which there are as many as shuffle partitions.
    """
    ranged = df.repartitionByRange(shuffle_parts(df.sparkSession), *order).withColumn("_range", F.spark_partition_id())
    stored = durable(ranged)
    sizes = stored.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return stored.withColumn("_inside", inside).join(before, "_range").withColumn(name, (F.col("_inside") + F.col("_before")).cast("long")).drop("_range", "_inside", "_before")


def children(parents: DataFrame, rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, n_children, children): for every parent its rows' values in order; one join for all parents. Without children: 0 and an empty array."""
    listed = rows.groupBy(key).agg(F.count("*").alias("n_children"), F.transform(F.sort_array(F.collect_list(F.struct(*order, value))), lambda r: r[value]).alias("children"))
    empty = F.array().cast(listed.schema["children"].dataType)
    return parents.select(key).join(listed, key, "left").select(key, F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.coalesce("children", empty).alias("children"))


def is_active(state: Column) -> Column:
    return ~state.eqNullSafe(F.lit("deleted"))


def is_unfinished(state: Column, n_linked: Column) -> Column:
    """Not deleted, and not imported or without a linked record."""
    return is_active(state) & (~state.eqNullSafe(F.lit("imported")) | (F.coalesce(n_linked, F.lit(0)) == 0))


def first_write_wins(stored: DataFrame, writes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value): what was stored, else the write that came; a stored value is never replaced."""
    new = writes.select(*keys, F.col(value).alias("_new"))
    return stored.join(new, keys, "left").withColumn(value, F.coalesce(value, "_new")).drop("_new")


def schema_version(versions: DataFrame, column: str) -> DataFrame:
    """One row: the greatest version, 0 where there is none."""
    return versions.agg(F.coalesce(F.max(column), F.lit(0)).cast("long").alias("version"))


def first_where(rows: DataFrame, keys: list[str], order: list[str], value: str, condition: Column) -> DataFrame:
    """(keys, value): of each group the first row that meets the condition; null where none does."""
    return rows.groupBy(*keys).agg(F.min_by(F.when(condition, F.col(value)), F.when(condition, F.struct(*order))).alias(value))


def batch_to_delete(rows: DataFrame, due: Column, order: list[Column], limit: int) -> DataFrame:
    """The first `limit` rows that are due: a bounded batch, the feature being the bound."""
    return rows.where(due).orderBy(*order).limit(limit)


def in_scope(rows: DataFrame, scope: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): rows whose page is in the scope, and the others."""
    wanted = scope.select(*keys).distinct()
    return rows.join(wanted, keys, "left_semi"), rows.join(wanted, keys, "left_anti")


def unique_in_order(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, values): each group's distinct values, by where they are first; summed up per value before the list is made."""
    first = rows.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_at"))
    return first.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", value))), lambda r: r[value]).alias("values"))


def units_in_order(rows: DataFrame, keys: list[str], order: list[str], unit: str, common: list[str]) -> DataFrame:
    """(keys, suggested, others): the group's units without regard to case, in the first spelling seen and in that order; and the common ones it lacks."""
    first = rows.where(F.col(unit).isNotNull()).groupBy(*keys, F.lower(unit).alias("_low")).agg(F.min(F.struct(*order)).alias("_at"), F.min_by(unit, F.struct(*order)).alias("_unit"))
    listed = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_at", "_unit", "_low"))).alias("_l"))
    lows = F.transform("_l", lambda r: r["_low"])
    rest = F.filter(F.array(*[F.lit(c) for c in common]), lambda c: ~F.array_contains(lows, F.lower(c)))
    return listed.select(*keys, F.transform("_l", lambda r: r["_unit"]).alias("suggested"), rest.alias("others"))


def metadata_by_id(asked: DataFrame, measurements: DataFrame, records: DataFrame, of_measurement: list[str], of_record: list[str]) -> DataFrame:
    """asked (measurement_id) with the record that has the measurement and the columns named of both; of several with the id, that of the first record counts. Null for an unknown or null id."""
    first = measurements.groupBy("measurement_id").agg(F.min_by(F.struct("record_id", *of_measurement), F.struct("record_id", "measurement_ordinal")).alias("_m"))
    held = first.select("measurement_id", "_m.*").join(records.select("record_id", *of_record), "record_id", "left")
    return asked.join(held, "measurement_id", "left")


def locale_key(text: Column, locale: str = "UNICODE") -> Column:
    """text so that it is sorted and compared as people of that locale do; without it strings are in the order of their code points."""
    return F.collate(text, locale)


def ends_of_order(rows: DataFrame, keys: list[str], text: str, locale: str = "UNICODE") -> DataFrame:
    """(keys, first_local, last_local, first_code, last_code): the ends of a group's texts in both orders; texts that the locale holds equal are told apart by code points."""
    w = F.col(text).cast("string")
    pair = F.struct(locale_key(w, locale).alias("k"), w.alias("w"))
    found = rows.groupBy(*keys).agg(F.min(pair).alias("a"), F.max(pair).alias("b"), F.min(w).alias("first_code"), F.max(w).alias("last_code"))
    return found.select(*keys, F.col("a.w").alias("first_local"), F.col("b.w").alias("last_local"), "first_code", "last_code")


def grant_purchases(grants: DataFrame, purchases: DataFrame) -> DataFrame:
    """grants (source) with the purchase (transaction_id) whose id follows `grant:` in it, up to the next colon; an equi-join on the id taken out."""
    with_id = grants.withColumn("transaction_id", F.regexp_extract("source", "^grant:([^:]+):", 1))
    return with_id.join(purchases, "transaction_id", "left")


def by_sequence(left: DataFrame, right: DataFrame, ids: str) -> DataFrame:
    """Rows of both sides whose lists of source ids are the same, in the same order; joined on a hash and compared."""
    a, b = left.withColumn("_key", F.xxhash64(ids)), right.withColumnRenamed(ids, "_ids").withColumn("_key", F.xxhash64("_ids"))
    return a.join(b, (a["_key"] == b["_key"]) & (a[ids] == b["_ids"])).drop("_key", "_ids")


# The seeds of the four words of a row id.
FNV_SEEDS = [2166136261, 2246822519, 3266489917, 668265263]


def row_id(key: Column, prefix: str = "gw-") -> Column:
    """An opaque id of a key of ASCII: four FNV-1a words in hex behind a prefix."""
    return F.concat(F.lit(prefix), *[F.lower(F.lpad(F.hex(fnv1a(key, seed)), 8, "0")) for seed in FNV_SEEDS])


def fnv1a(text: Column, seed: int) -> Column:
    """FNV-1a of 32 bits over the characters of a text of ASCII, from a seed of one's own."""
    codes = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substr(text, i, F.lit(1))).cast("long"))
    hashed = F.aggregate(codes, F.lit(seed).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(F.length(text) > 0, hashed).otherwise(F.lit(seed).cast("long"))


def physical_row_metrics(counts: DataFrame) -> DataFrame:
    """counts with recall, precision (duplicates that were consumed count against it) and review burden; `valid` where the counts fit each other.

    counts: n_rows, n_referenced, n_admitted, n_correct, n_review, n_duplicates.
    """
    from ..functions.numbers import ratio

    c = F.col
    valid = (c("n_referenced") <= c("n_rows")) & (c("n_correct") <= c("n_admitted")) & (c("n_admitted") + c("n_review") <= c("n_rows"))
    return counts.select(
        "*", valid.alias("valid"), ratio(c("n_referenced"), c("n_rows")).alias("raw_recall"), ratio(c("n_correct"), c("n_rows")).alias("recall"),
        ratio(c("n_correct"), c("n_admitted") + c("n_duplicates")).alias("precision"), ratio(c("n_review"), c("n_rows")).alias("review_burden"),
    )
