"""Completeness, set differences and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def two_sided_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of one side only, with the side."""
    left = a.distinct().join(b, a.columns, "left_anti").withColumn("side", F.lit("left"))
    right = b.distinct().join(a, a.columns, "left_anti").withColumn("side", F.lit("right"))
    return left.unionByName(right)


def assignment_faults(inputs: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    """Keys that are not assigned exactly once, with how often they are, and whether they are inputs at all."""
    n = assigned.groupBy(key).agg(F.count(F.lit(1)).alias("times"))
    both = inputs.select(key).distinct().withColumn("known", F.lit(True)).join(n, key, "full")
    both = both.select(key, F.coalesce("times", F.lit(0)).cast("long").alias("times"), F.coalesce("known", F.lit(False)).alias("known"))
    return both.where("times <> 1 or not known")


def relational_division(pairs: DataFrame, who: str, what: str, wanted: DataFrame) -> DataFrame:
    """Those who have every one of the wanted values. wanted has one column, what."""
    n = wanted.agg(F.count_distinct(what).alias("need"))
    have = pairs.select(who, what).distinct().join(wanted.distinct(), what, "left_semi").groupBy(who).agg(F.count(F.lit(1)).alias("have"))
    return have.join(F.broadcast(n), F.col("have") == F.col("need")).select(who)


def precision_recall(truth: DataFrame, said: DataFrame, keys: list[str]) -> DataFrame:
    """One row: matched, declared, expected, precision, recall, f1 of two sets of keys; empty sets count as perfect."""
    t, s = truth.select(*keys).distinct().withColumn("t", F.lit(1)), said.select(*keys).distinct().withColumn("s", F.lit(1))
    sums = t.join(s, keys, "full").agg(F.coalesce(F.sum(F.col("t") * F.col("s")), F.lit(0)).alias("matched"), F.count("s").alias("declared"), F.count("t").alias("expected"))
    ratio = lambda n: F.when(F.col(n) == 0, F.lit(1.0)).otherwise(F.col("matched") / F.col(n))
    out = sums.withColumn("precision", ratio("declared")).withColumn("recall", ratio("expected"))
    f1 = F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return out.withColumn("f1", f1)


def mode(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, the least among equals."""
    n = df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*groups).agg(F.max_by(value, F.struct("n", -F.col(value))).alias(value), F.max("n").alias("n"))


def top_per_group(df: DataFrame, groups: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= n)


def object_aggregate(df: DataFrame, groups: list[str], key: str, value: str, name: str = "object") -> DataFrame:
    """A JSON object of each group, its keys in order; of a key's several values the greatest counts, rows without a key none.

    Null values stay as nulls. A group all of whose keys are null has no row.
    """
    one = df.where(F.col(key).isNotNull()).groupBy(*groups, F.col(key).cast("string").alias("_key")).agg(F.max(value).alias("_value"))
    entries = F.array_sort(F.collect_list(F.struct("_key", "_value")))
    return one.groupBy(*groups).agg(F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"}).alias(name))
