"""Tables that cut lineage, kept where every executor and the driver can read them."""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def package_root() -> str:
    """The folder that holds the package; Python workers need it on their path."""
    return os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship_package(spark: SparkSession) -> None:
    """Let Python workers that Spark starts from now on import this package."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if package_root() not in parts:
        env["PYTHONPATH"] = os.pathsep.join([package_root(), *parts])


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Unset, a folder of this process serves where all runs on one machine; on a cluster that is an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not _OWN:
        import atexit

        _OWN.append(tempfile.mkdtemp(prefix="loomspark-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write df to the shared folder (in folders by the columns named) and read it back: later reads neither recompute it nor need the executors that made it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._written_at = path
    return found


def together(tables: list[DataFrame]) -> DataFrame:
    """The rows of tables of one schema that written() made, as one scan however many they are."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[t._written_at for t in tables])


class Gathered:
    """Tables of one schema that come one by one. Sixteen of a size are written as one, so a scan of all has few paths however many came."""

    def __init__(self, *tables: DataFrame):
        self.held: list[tuple[int, DataFrame]] = []
        for t in tables:
            self.add(t)

    def add(self, table: DataFrame) -> None:
        self.held.append((0, table))
        while len(self.held) >= 16 and self.held[-16][0] == self.held[-1][0]:
            level, last = self.held[-1][0], [t for _, t in self.held[-16:]]
            self.held[-16:] = [(level + 1, written(together(last), "gathered"))]
            # the newest is still read as the front of the next round
            forget(*last[:-1])

    def rows(self) -> DataFrame:
        return together([t for _, t in self.held])


def forget(*tables: DataFrame | None) -> None:
    """Delete tables that written() made and that nothing reads any more."""
    for df in tables:
        if df is not None and (path := getattr(df, "_written_at", None)):
            drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, whichever file system holds it."""
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
