"""The worklist's state as a stream: the last event of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.sources.workspace import fresh_path


def stream_latest(spark: SparkSession, path: str, keys: list[str], order: str, *values: str) -> DataFrame:
    """Read a parquet file stream to its present end and return the last event of each key.

    The aggregate is a partial maximum, so state holds one row a key. Each batch replaces the result table as a whole.
    """
    schema = spark.read.parquet(path).schema
    out, marks = fresh_path(spark, "latest"), fresh_path(spark, "progress")
    events = spark.readStream.schema(schema).parquet(path)
    last = events.groupBy(*keys).agg(F.max(F.struct(order, *values)).alias("e"))

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    last.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(*keys, *[F.col(f"e.{c}").alias(c) for c in (order, *values)])
