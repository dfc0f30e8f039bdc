"""Content-addressed storage: bytes are named by their SHA-256."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.sources.workspace import written


def hashed_files(spark: SparkSession, path: str) -> DataFrame:
    """data_id, byte_size, content, path of every file under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.sha2("content", 256).alias("data_id"), F.length("content").cast("long").alias("byte_size"), "content", "path")


def publish(data: DataFrame, path: str) -> DataFrame:
    """Store each distinct content (data_id, byte_size, content) that path doesn't hold yet; returns the new ids.

    Folders follow the first two digits of the id, so a read by id opens one of 256. The store only grows.
    """
    spark = data.sparkSession
    new = data.select(F.substring("data_id", 1, 2).alias("shard"), "data_id", "byte_size", "content").dropDuplicates(["data_id"])
    if has_store(spark, path):
        new = new.join(spark.read.parquet(path).select("shard", "data_id"), ["shard", "data_id"], "left_anti")
    new = written(new, "published")
    new.write.mode("append").partitionBy("shard").parquet(path)
    return new.select("data_id", "byte_size")


def has_store(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def verified(spark: SparkSession, path: str) -> DataFrame:
    """Everything stored, with valid false where bytes don't have the id or size they are stored under."""
    rows = spark.read.parquet(path)
    return rows.select("data_id", "byte_size", "content", ((F.sha2("content", 256) == F.col("data_id")) & (F.length("content") == F.col("byte_size"))).alias("valid"))


def import_states(requests: DataFrame, known: DataFrame) -> DataFrame:
    """The end state of each import request (request_id, data_id): committed for the first of a content that isn't known, else duplicate."""
    first = requests.groupBy("data_id").agg(F.min("request_id").alias("first"))
    marked = requests.join(first, "data_id").join(known.select("data_id", F.lit(True).alias("known")).distinct(), "data_id", "left")
    return marked.select("request_id", "data_id", F.when(F.col("known").isNull() & (F.col("request_id") == F.col("first")), "committed").otherwise("duplicate").alias("state"))


def replays(requests: DataFrame) -> DataFrame:
    """Requests sent more than once (request_id, fingerprint, order): each after the first is a replay, or a conflict if its fingerprint differs."""
    w = Window.partitionBy("request_id").orderBy("order")
    first = F.first("fingerprint").over(w)
    return requests.withColumn("n", F.row_number().over(w)).withColumn("state", F.when(F.col("n") == 1, "new").when(F.col("fingerprint").eqNullSafe(first), "replay").otherwise("idempotency_conflict")).drop("n")


def segmented(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, manifest) of data cut into parts (data_id, pos, body): equal segments are stored once; the manifest orders them."""
    named = parts.withColumn("segment_id", F.sha2("body", 256))
    return named.select("segment_id", "body").dropDuplicates(["segment_id"]), named.select("data_id", "pos", "segment_id")


def reassembled(segments: DataFrame, manifest: DataFrame) -> DataFrame:
    """data_id, content, whole (whether it has its id) put together from segments."""
    rows = manifest.join(segments, "segment_id").groupBy("data_id").agg(F.array_sort(F.collect_list(F.struct("pos", "body"))).alias("p"))
    built = rows.select("data_id", F.aggregate(F.col("p.body"), F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x)).alias("content"))
    return built.withColumn("whole", F.sha2("content", 256) == F.col("data_id"))
