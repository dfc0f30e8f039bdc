"""Intervals and boxes: joins, coverage and tiling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(a0: str, a1: str, b0: str, b1: str, closed: bool = False) -> Column:
    """Whether two ranges share a point; half-open unless closed."""
    first, last = F.greatest(F.col(a0), F.col(b0)), F.least(F.col(a1), F.col(b1))
    return first <= last if closed else first < last


def overlap_join(a: DataFrame, b: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of ranges (a_start, a_end), (b_start, b_end) of the same key that overlap.

    Ranges are dealt to bins of `width` positions, and bins join the key as an equi-join, so a key with many ranges
    costs what overlaps rather than all pairs; a pair counts in the first bin that both reach.
    """
    def binned(df: DataFrame, s: str, e: str) -> DataFrame:
        lo, hi = F.floor(F.col(s) / width), F.floor((F.greatest(F.col(e), F.col(s) + 1) - 1) / width)
        return df.withColumn("bin", F.explode(F.sequence(lo, hi)))

    pairs = binned(a, "a_start", "a_end").join(binned(b, "b_start", "b_end"), [key, "bin"])
    return pairs.where(overlaps("a_start", "a_end", "b_start", "b_end") & (F.col("bin") == F.floor(F.greatest("a_start", "b_start") / width))).drop("bin")


def match_kind(a0: str, a1: str, b0: str, b1: str) -> Column:
    return F.when((F.col(a0) == F.col(b0)) & (F.col(a1) == F.col(b1)), "exact_text_range").otherwise("overlapping_text_range")


def boxes_overlap(a: str, b: str) -> Column:
    """Strict overlap of boxes [x0, y0, x1, y1]."""
    p, q = F.col(a), F.col(b)
    return (F.greatest(p[0], q[0]) < F.least(p[2], q[2])) & (F.greatest(p[1], q[1]) < F.least(p[3], q[3]))


def shared_of_smaller(a: str, b: str) -> Column:
    """Area that two boxes share, as a part of the smaller one."""
    p, q = F.col(a), F.col(b)
    side = lambda i: F.greatest(F.lit(0.0), F.least(p[i + 2], q[i + 2]) - F.greatest(p[i], q[i]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return side(0) * side(1) / F.least(area(p), area(q))


def coverage_violations(spans: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Keys whose spans (char_start, char_end) leave a gap in [0, size), with what is wrong; sizes: key, size."""
    order = Window.partitionBy(key).orderBy("char_start", "char_end")
    reach = F.max("char_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    per = spans.withColumn("gap", F.col("char_start") > reach).groupBy(key).agg(F.min("char_start").alias("lo"), F.max("char_end").alias("hi"), F.coalesce(F.bool_or("gap"), F.lit(False)).alias("gap"))
    reason = F.when(F.col("lo").isNull(), "missing").when(F.col("lo") != 0, "start").when(F.col("hi") != F.col("size"), "end").when(F.col("gap"), "gap")
    return sizes.join(per, key, "left").withColumn("reason", reason).where("reason is not null").select(key, "reason")


def tiling_violations(spans: DataFrame, sizes: DataFrame, key: str, step: int = 0) -> DataFrame:
    """Spans that don't begin `step` after the end of the one before (the first: at 0), or whose last doesn't end at size."""
    order = Window.partitionBy(key).orderBy("char_start", "char_end")
    want = F.coalesce(F.lag("char_end").over(order) + step, F.lit(0))
    marked = spans.withColumn("expected", want).withColumn("last", F.lead("char_start").over(order).isNull()).join(sizes, key)
    return marked.where("char_start <> expected or last and char_end <> size").select(key, "char_start", "expected")


def unique_match(pieces: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """For each piece (piece_id, key): matched if one source (source_id, key) has its key, unmatched if none, else ambiguous."""
    found = sources.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("source_id").alias("source_id"))
    return pieces.join(found, key, "left").select(
        "piece_id", F.when(F.col("n").isNull(), "unmatched").when(F.col("n") == 1, "matched").otherwise("ambiguous").alias("status"), F.when(F.col("n") == 1, F.col("source_id")).alias("source_id")
    )
