"""Arrow-batched maps over whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from loomspark.sources.workspace import written

#: Texts are handed on in groups of about this many characters, so that memory does not follow the length of texts.
CHARS_AT_ONCE = 2_000_000
ROWS_AT_ONCE = 2000
#: Bytes in memory of a side that side_join and side_of broadcast, at most: below it a shuffle's tasks cost more than its rows.
SIDE_BYTES = 3_000_000


def schema_of(ddl: str | StructType) -> StructType:
    return ddl if isinstance(ddl, StructType) else _parse_datatype_string(ddl)


def groups(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[list[list]]:
    """Columns as lists, cut so that the text column holds about CHARS_AT_ONCE at most (one text is never cut)."""
    for batch in batches:
        n, lo = batch.num_rows, 0
        size = max(1, int(n * CHARS_AT_ONCE / max(1, batch.column(text).nbytes)))
        while lo < n:
            part = batch.slice(lo, size)
            lo += size
            yield [c.to_pylist() for c in part.columns]


def small_batches(df: DataFrame) -> DataFrame:
    """df, in whose session a batch to Python holds ROWS_AT_ONCE rows at most: a batch of whole texts is held on both sides."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS_AT_ONCE:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_AT_ONCE))
    return df


def map_batches(df: DataFrame, start: Callable[[], Callable[..., list]], ddl: str, text: int = 1) -> DataFrame:
    """mapInArrow over groups of rows. start() makes, once for each task, f(*columns) -> columns of the result."""
    out = schema_of(ddl)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for columns in groups(batches, text):
            made = f(*columns)
            if made is not None and len(made[0]):
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, type=t) for v, t in zip(made, arrow.types, strict=True)], schema=arrow)

    return small_batches(df).mapInArrow(run, out)


def texts_of(documents: DataFrame) -> DataFrame:
    """doc_id and text of documents, a null text as the empty one; other columns, whatever their names, are left aside."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def fits_in(df: DataFrame, bound: int) -> bool:
    """Whether the rows of a written table of fixed-width columns take bound bytes in memory at most."""
    width = sum(64 if f.dataType.simpleString() == "string" else 8 for f in df.schema.fields) + 40
    return df.count() * width <= bound


def small_enough(df: DataFrame, bound: int = 64_000_000) -> DataFrame:
    """A written table of fixed-width columns, to be broadcast if its rows take less than bound bytes in memory, else to be merged."""
    return F.broadcast(df) if fits_in(df, bound) else df.hint("merge")


def side_of(df: DataFrame) -> DataFrame:
    """small_enough, with SIDE_BYTES as its bound."""
    return small_enough(df, SIDE_BYTES)


def spread_join(rows: DataFrame, side: DataFrame, key: str, size: str, bound: int) -> DataFrame:
    """rows joined with side (a written table, one row a key, with how many rows a key has).

    Keys with more than bound rows, of which there are few by the choice of bound, are broadcast and their rows stay where they
    are; all others are merged. So no task gets more than about bound rows of one key.
    """
    many = side.where(F.col(size) > bound)
    hot = rows.join(F.broadcast(many.drop(size)), key)
    other = rows.join(F.broadcast(many.select(key)), key, "left_anti").join(side.where(F.col(size) <= bound).drop(size).hint("merge"), key)
    return hot.unionByName(other)


def side_join(rows: DataFrame, side: DataFrame, key: str, size: str, bound: int) -> DataFrame:
    """spread_join for a side of fixed-width columns, which is broadcast whole if it takes SIDE_BYTES at most: rows needn't be shuffled then."""
    return rows.join(F.broadcast(side.drop(size)), key) if fits_in(side, SIDE_BYTES) else spread_join(rows, side, key, size, bound)


def carried(documents: DataFrame, judged: DataFrame, mark: Column) -> DataFrame:
    """The rows of documents that stay, with their columns, in order.

    judged, a written table, has doc_id, mark and stays for each row of documents; of rows that agree in doc_id and mark
    all stay, or one at most. Rows whose doc_id no dropped row has pass by it alone; else the mark decides. The other
    columns may have any names.
    """
    hit = written(judged.groupBy("doc_id").agg(F.bool_and("stays").alias("all"), F.bool_or("stays").alias("some")).where("not all"), "hit")
    key, own, gone, said = unused(documents, "key", "own", "gone", "said")
    keyed = documents.withColumn(key, F.col("doc_id").cast("long"))
    stay = keyed.join(small_enough(written(hit.select(F.col("doc_id").alias(gone)), "gone")), F.col(key).eqNullSafe(F.col(gone)), "left_anti").drop(key)
    shared = written(hit.where("some").select(F.col("doc_id").alias(gone)), "shared")
    if shared.isEmpty():
        return stay
    mixed = judged.join(small_enough(shared), F.col("doc_id").eqNullSafe(F.col(gone)), "left_semi").groupBy("doc_id", "mark")
    mixed = mixed.agg(F.bool_and("stays").alias("each"), F.bool_or("stays").alias("any")).where("any")
    mixed = written(mixed.select(F.col("doc_id").alias(gone), F.col("mark").alias(said), "each"), "mixed")
    some = keyed.join(small_enough(shared), F.col(key).eqNullSafe(F.col(gone)), "left_semi").withColumn(own, mark)
    same = F.col(key).eqNullSafe(F.col(gone)) & (F.col(own) == F.col(said))
    each = some.join(small_enough(mixed.where("each").drop("each")), same, "left_semi")
    one = some.join(small_enough(mixed.where("not each").drop("each")), same, "left_semi").dropDuplicates([key, own])
    return stay.unionByName(each.drop(key, own)).unionByName(one.drop(key, own))
