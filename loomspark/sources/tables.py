"""Table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; any file system that Spark knows."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
