"""Content identity, version chains and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.digests import sha256_text


def exact_dedup(documents: DataFrame) -> DataFrame:
    """doc_id, data_id, first_id and state of each document: published for the first of a content, else duplicate.

    Digests, not texts, are shuffled, after a partial minimum in each task.
    """
    named = documents.select("doc_id", sha256_text(F.col("text")).alias("data_id"))
    first = named.groupBy("data_id").agg(F.min("doc_id").alias("first_id"))
    return named.join(first, "data_id").select("doc_id", "data_id", "first_id", F.when(F.col("doc_id") == F.col("first_id"), "published").otherwise("duplicate").alias("state"))


def version_chain(rows: DataFrame, series: list[str], order: str, data: str) -> DataFrame:
    """Versions of each series: consecutive equal data are one version. version_number from 1, parent, is_head."""
    w = Window.partitionBy(*series).orderBy(order)
    kept = rows.withColumn("prev", F.lag(data).over(w)).where(F.col("prev").isNull() | (F.col("prev") != F.col(data)))
    out = kept.withColumn("version_number", F.row_number().over(w).cast("long")).withColumn("parent", F.lag(order).over(w)).withColumn("next", F.lead(order).over(w))
    return out.select(*series, order, data, "version_number", "parent", F.col("next").isNull().alias("is_head"))


def version_status(chain: DataFrame, series: list[str], data: str) -> DataFrame:
    """current if every series that has the data has it at its head, else historical."""
    per = chain.groupBy(data, *series).agg(F.bool_or("is_head").alias("head"))
    return per.groupBy(data).agg(F.bool_and("head").alias("all_heads"), F.count(F.lit(1)).alias("series_count")).select(data, F.when(F.col("all_heads"), "current").otherwise("historical").alias("status"), "series_count")


def manifest_diff(old: DataFrame, new: DataFrame, path: str, digest: str) -> DataFrame:
    """path and state: added, removed, changed or unchanged."""
    o, n = old.select(path, F.col(digest).alias("o")), new.select(path, F.col(digest).alias("n"))
    state = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "changed").otherwise("unchanged")
    return o.join(n, path, "full").select(path, state.alias("state"))


def source_kind(media: Column, parser: Column, origin: Column) -> Column:
    """The kind of a source: origin first, then how it was parsed, then its media type."""
    return (
        F.when(origin == "web", "web").when(parser == "code", "code").when(media == "application/pdf", "pdf").when(media == "text/markdown", "markdown")
        .when(media.startswith("image/"), "image").when(media.startswith("text/"), "text").otherwise("other")
    )
