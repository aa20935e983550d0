"""Registration of queries, and access to the tables that they read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one data folder, read when they are first named."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, df: DataFrame) -> DataFrame:
        """df, dealt over all cores if it is read in fewer splits than there are: for work on rows that costs far more than a shuffle."""
        cores = self.spark.sparkContext.defaultParallelism
        few = len(df.inputFiles()) < cores and df.rdd.getNumPartitions() < cores
        return df.repartition(cores) if few else df

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """df, written between jobs into a new folder that driver and executors share, and read back from there."""
        path = scratch(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir. Only a local session may do without that setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="loomwork-")
    return f"{path.rstrip('/')}/loomwork/{uuid.uuid4().hex}/{name}"


def query(name: str, sql: str | None = None):
    """Register a function of Tables as a query; sql states the same rows in ANSI SQL."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return f

    return register
