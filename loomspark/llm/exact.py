"""Operator 8: exact deduplication behind a two-pass Bloom filter, in DataFrame functions only.

Texts are equal when they are identical without the characters U+0020 and U+0009 to U+000D. Of equal texts the one
with the most code points stays, then the smallest doc_id (a null doc_id comes after all others; rows that agree in
both are told apart by a row number). A null text is the empty text. An empty table gives no rows. Columns besides
doc_id and text are left aside by groups(); keep() returns the rows of the input with all their columns, whatever their names.

Each text is read once, for its digest, its length and a 64-bit hash, in a written table of slim rows. First pass: hashes,
8 bytes a row and none of its other columns, are counted with a partial count in each task; those that occur again make a
Bloom filter of BITS bits and PROBES positions for each of them, which lie in one word, in blocks of 512 bytes. Its size
follows the repeated hashes alone. Second pass: a row that isn't in the broadcast filter has no equal and passes straight
through where it is; only the others shuffle, and are grouped by their SHA-256.

A filter above SLICE_BYTES is made in slices by hash: the slim rows are written by slice, and each slice probes its own
part of the filter, so no size makes the other rows shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.batches import carried, spread_join
from loomspark.sources.workspace import forget, written

BITS = 16
PROBES = 4
WORDS = 64
SLICE_BYTES = 64_000_000
BLANKS = " \t\n\v\f\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def places(h: Column, blocks: int) -> list[Column]:
    """block, word and mask: where a hash has its bits in a filter of so many blocks."""
    g = F.xxhash64(h, F.lit(1))
    bits = [F.expr("1L") for _ in range(PROBES)]
    bits = [F.call_function("shiftleft", b, F.shiftrightunsigned(g, 6 * (k + 1)).bitwiseAND(F.lit(63)).cast("int")) for k, b in enumerate(bits)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return [F.pmod(h, F.lit(blocks)).alias("block"), g.bitwiseAND(F.lit(WORDS - 1)).cast("int").alias("word"), mask.alias("mask")]


def blocks_for(n: int) -> int:
    return max(1, math.ceil(n * BITS / (64 * WORDS)))


def bloom(hashes: DataFrame, n: int) -> DataFrame:
    """block, words: a Bloom filter of about n hashes (column h)."""
    bits = hashes.select(*places(F.col("h"), blocks_for(n))).groupBy("block", "word").agg(F.bit_or("mask").alias("bits"))
    held = bits.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("held"))  # WORDS at most
    return held.select("block", F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda k: F.coalesce(F.col("held")[k], F.lit(0).cast("long"))).alias("words"))


def probed(rows: DataFrame, hashes: DataFrame, n: int) -> DataFrame:
    """rows with maybe: whether h may be one of the n hashes. Rows stay where they are: the filter is broadcast, at most SLICE_BYTES of it."""
    block, word, mask = places(F.col("h"), blocks_for(n))
    at = rows.withColumns({"block": block, "word": word, "mask": mask}).join(F.broadcast(bloom(hashes, n)), "block", "left")
    hit = F.get("words", "word").bitwiseAND(F.col("mask")) == F.col("mask")
    return at.withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("block", "word", "mask", "words")


def groups(documents: DataFrame) -> DataFrame:
    """One row for each row of documents: doc_id, keep_id, group_size, kept, text_sha256, and n_chars of the original."""
    norm = normalised(F.col("text"))
    slim = written(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(norm).alias("h"), F.sha2(norm.cast("binary"), 256).alias("text_sha256"),
            F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_chars"), F.monotonically_increasing_id().alias("row"),
        ), "digests",
    )
    again = written(slim.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"), "again")
    n = again.count()
    slices = math.ceil(n * BITS / 8 / SLICE_BYTES) or 1
    if slices == 1:
        flagged = written(probed(slim, again, n), "flagged")
    else:
        own = F.pmod(F.xxhash64(F.col("h"), F.lit(2)), F.lit(slices)).cast("int").alias("slice")
        by_slice, again_by = written(slim.select("*", own), "sliced", "slice"), written(again.select("*", own), "again", "slice")
        made = [written(probed(by_slice.where(F.col("slice") == k).drop("slice"), again_by.where(F.col("slice") == k).drop("slice"), -(-n // slices)), "flagged") for k in range(slices)]
        flagged = made[0]
        for more in made[1:]:
            flagged = flagged.unionByName(more)
        forget(by_slice, again_by)
    forget(slim, again)
    alone = flagged.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "n_chars")
    many = flagged.where("maybe")
    order = F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("row").alias("d"))
    best = many.groupBy("text_sha256").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
    best = written(best.withColumn("size", F.col("group_size")), "groups")
    # groups of at least a thousandth of these rows are at most a thousand: their rows stay where they are
    bound = max(100, (best.agg(F.sum("group_size")).first()[0] or 0) // 1000)
    judged = spread_join(many, best, "text_sha256", "size", bound).select(
        "doc_id", F.col("best.c").alias("keep_id"), "group_size", (F.col("row") == F.col("best.d")).alias("kept"), "text_sha256", "n_chars"
    )
    return alone.unionByName(judged)


def digest(documents: DataFrame) -> DataFrame:
    """The query's columns."""
    return groups(documents).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep(documents: DataFrame) -> DataFrame:
    """The rows of documents that stay, with their columns, in order.

    Rows none of whose copies goes pass by their doc_id alone. Where rows share a doc_id and only some of them stay,
    the text decides; of rows that agree in both, one stays.
    """
    mark = F.concat_ws(":", F.col("text_sha256"), F.col("n_chars").cast("string"))
    judged = written(groups(documents).select("doc_id", mark.alias("mark"), F.col("kept").alias("stays")), "judged")
    own = F.concat_ws(":", F.sha2(normalised(F.col("text")).cast("binary"), 256), F.length(F.coalesce("text", F.lit(""))).cast("string"))
    return carried(documents, judged, own)


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
), r AS (
  SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY n_chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM r
"""
