"""Predicates over records, coverage of what has to be covered, and joins of places on a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What identifiers and paths look like.
SHA256 = "^[0-9a-f]{64}$"
SLUG = "^[a-z0-9]+(-[a-z0-9]+)*$"
SAFE_PATH = r"^(?!/)(?!.*(^|/)\.\.?(/|$))(?!.*//)[^\\\x00-\x1f]+$"
UUID7 = "^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def has_keys(json: Column, keys: list[str]) -> Column:
    """Whether a JSON object has exactly these keys; false for what is no object."""
    found = F.json_object_keys(json)
    return F.coalesce(F.array_sort(found) == F.array(*[F.lit(k) for k in sorted(keys)]), F.lit(False))


def contained(inner: Column, outer: Column) -> Column:
    """Whether an array has only elements of another and no null."""
    return ~F.exists(inner, lambda x: x.isNull()) & (F.size(F.array_except(inner, outer)) == 0)


def json_has(json: Column, path: str) -> Column:
    return F.get_json_object(json, path).isNotNull()


def changed_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key of rows of either table that the other lacks or has with another value in any column (null equals null)."""
    rest = [c for c in old.columns if c != key]
    a, b = (t.select(key, F.struct(*rest).alias(n), F.lit(True).alias(f"in_{n}")) for t, n in ((old, "a"), (new, "b")))
    both = a.join(b, key, "full")
    return both.where(F.col("in_a").isNull() | F.col("in_b").isNull() | ~F.col("a").eqNullSafe(F.col("b"))).select(
        key, F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").otherwise("changed").alias("change")
    )


def same_multiset(a: DataFrame, b: DataFrame, group: str, value: str) -> DataFrame:
    """group, same: whether a group's values are the same, as often, in both tables."""
    n = a.groupBy(group, value).agg(F.count(F.lit(1)).alias("n")).withColumn("m", F.lit(0).cast("long"))
    m = b.groupBy(group, value).agg(F.count(F.lit(1)).alias("m")).withColumn("n", F.lit(0).cast("long"))
    both = n.unionByName(m).groupBy(group, value).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    return both.groupBy(group).agg(F.bool_and(F.col("n") == F.col("m")).alias("same"))


def incomplete_links(matches: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """key, missing: how many elements of the array `wanted` have no match (key, item)."""
    got = matches.select(key, "item").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("got"))
    return wanted.join(got, key, "left").withColumn("missing", F.size("wanted") - F.coalesce("got", F.lit(0))).where("missing <> 0").select(key, F.col("missing").cast("long").alias("missing"))


def ids_or(own: Column, other: Column) -> Column:
    """Sorted distinct ids, or those of the other list where there are none."""
    ids = F.array_sort(F.array_distinct(own))
    return F.when(F.size(ids) > 0, ids).otherwise(F.array_sort(F.array_distinct(other)))


def first_order(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """group, values: each value once, where it first stood."""
    first = rows.groupBy(group, value).agg(F.min(order).alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", value)))
    return first.groupBy(group).agg(F.array_join(F.transform(ordered, lambda x: x[value].cast("string")), ",").alias("values"))


def coverage(wanted: DataFrame, given: DataFrame, key: str, number: str) -> DataFrame:
    """key, number, fault: numbers from 0 to n - 1 that aren't there, or there more than once, or beyond. wanted: key, n; given: key, number."""
    asked = wanted.where("n > 0").select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias(number), F.lit(True).alias("asked"))
    got = given.groupBy(key, F.col(number).cast("long").alias(number)).agg(F.count(F.lit(1)).alias("times"))
    both = asked.join(got, [key, number], "full")
    fault = F.when(F.col("times").isNull(), "missing").when(F.col("asked").isNull(), "beyond").when(F.col("times") > 1, "repeated")
    return both.withColumn("fault", fault).where("fault is not null").select(key, number, "fault")


def figure_ledger(required: DataFrame, decisions: DataFrame) -> DataFrame:
    """document, figure, status: covered if a decision accepts it with a place, incomplete if one accepts it without, else pending.

    required: document, figure; decisions: document, figure, accepted, place.
    """
    best = decisions.groupBy("document", "figure").agg(F.max(F.when(F.col("accepted"), F.when(F.col("place").isNotNull(), 2).otherwise(1)).otherwise(0)).alias("level"))
    status = F.when(F.col("level") == 2, "covered").when(F.col("level") == 1, "incomplete").otherwise("pending")
    return required.distinct().join(best, ["document", "figure"], "left").select("document", "figure", status.alias("status"))


def order_ties(blocks: DataFrame, page: list[str], index: str) -> DataFrame:
    """page, index, blocks: reading-order numbers that more than one block of a page has."""
    return blocks.groupBy(*page, index).agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1")


def neighbours(pages: DataFrame, key: str, number: str) -> DataFrame:
    """key, number, before, after: the numbers on either side if they are there (missing pages give null), one page away at most."""
    w = Window.partitionBy(key).orderBy(number)
    before, after = F.lag(number).over(w), F.lead(number).over(w)
    return pages.select(key, number, F.when(before == F.col(number) - 1, before).alias("before"), F.when(after == F.col(number) + 1, after).alias("after"))


def points_in_regions(points: DataFrame, regions: DataFrame, slack: float = 0.5, cell: float = 64.0) -> DataFrame:
    """point, region: points (point, page, x, y) within regions (region, page, x0, y0, x1, y1), with some slack at the borders.

    Both sides meet by page and a band of y, so that a point is compared with the regions of its band alone.
    """
    band = F.floor(F.col("y") / cell)
    bands = F.explode(F.sequence(F.floor((F.col("y0") - slack) / cell), F.floor((F.col("y1") + slack) / cell))).alias("band")
    met = points.withColumn("band", band).join(regions.select("region", "page", "x0", "y0", "x1", "y1", bands), ["page", "band"])
    inside = F.col("x").between(F.col("x0") - slack, F.col("x1") + slack) & F.col("y").between(F.col("y0") - slack, F.col("y1") + slack)
    return met.where(inside).select("point", "region")


def covering(objects: DataFrame, panels: DataFrame, share: float = 0.9, least: float = 0.75, most: float = 5.0) -> DataFrame:
    """panel, object: the smallest object of the page that covers a share of the panel and whose area is within bounds of its; ties by object."""
    area = lambda p: (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))
    a = objects.select("page", "object", *[F.col(c).alias(f"o{c}") for c in ("x0", "y0", "x1", "y1")])
    met = panels.join(a, "page")  # by page: a page's objects are few
    width = F.least("x1", "ox1") - F.greatest("x0", "ox0")
    height = F.least("y1", "oy1") - F.greatest("y0", "oy0")
    ratio = area("o") / area("")
    ok = met.where((width > 0) & (height > 0) & (width * height >= F.lit(share) * area("")) & ratio.between(least, most))
    return ok.groupBy("panel").agg(F.min_by("object", F.struct(area("o"), F.col("object"))).alias("object"))


def unordered_pairs(anchors: DataFrame, eligible: DataFrame, by: str, key: str, band: int) -> DataFrame:
    """a < b of anchors and eligible rows of one group, each pair once and none with itself; eligible rows within band of the anchor's key.

    The band keeps the pairs of a group in proportion to it; both sides meet by group and block of keys.
    """
    block = F.floor(F.col(key) / band)
    left = anchors.select(by, F.col(key).alias("p"), F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    right = eligible.select(by, F.col(key).alias("q"), block.alias("block"))
    met = left.join(right, [by, "block"]).where((F.col("p") != F.col("q")) & (F.abs(F.col("p") - F.col("q")) <= band))
    return met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def with_rank(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Rows with rank: the name's place in a fixed order, 99 if it has none."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(name))
    return rows.withColumn("rank", F.when(rank > 0, rank - 1).otherwise(99).cast("long"))


def freshness(index: DataFrame, state: dict) -> DataFrame:
    """index_id, status: 'fresh' if all that the index was built from is what holds now (a value for each column), else 'stale'."""
    same = F.lit(True)
    for c, v in state.items():
        same = same & F.col(c).eqNullSafe(F.lit(v))
    return index.select("index_id", F.when(same, "fresh").otherwise("stale").alias("status"))


def corpus_units(**kinds: DataFrame) -> DataFrame:
    """kind, unit_id, text of all kinds (each with unit_id, title, text): empty texts get a descriptor that says so; repeated ids count once, the least text."""
    out = None
    for kind, rows in sorted(kinds.items()):
        text = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", F.concat(F.lit(f"[{kind} without text] "), F.coalesce("title", F.lit("")))).otherwise(F.col("text"))
        one = rows.select(F.lit(kind).alias("kind"), "unit_id", text.alias("text"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("kind", "unit_id").agg(F.min("text").alias("text"))


def citation_faults(answers: DataFrame, known: DataFrame) -> DataFrame:
    """answer_id, fault: citations that repeat or that nothing resolves, and answers whose status doesn't fit. answers: answer_id, status, citations (array); known: ref."""
    cited = answers.select("answer_id", F.explode("citations").alias("ref"))
    repeated = cited.groupBy("answer_id", "ref").count().where("count > 1").select("answer_id", F.lit("repeated").alias("fault"))
    lost = cited.join(known.select("ref").distinct(), "ref", "left_anti").select("answer_id", F.lit("unresolved").alias("fault"))
    n = F.size(F.coalesce("citations", F.array().cast("array<string>")))
    wrong = answers.where(((F.col("status") == "answered") & (n == 0)) | ((F.col("status") == "no_answer") & (n > 0))).select("answer_id", F.lit("status").alias("fault"))
    return repeated.unionByName(lost).unionByName(wrong).distinct()
