"""Helpers shared by the training-data operators: shared folders, tables between jobs, column checks."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key with a 64th of all rows or more is hot; there are 64 such keys at most.
HOT_PARTS = 64
FEW_ROWS = 2_000
PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package from the path that the driver has it on."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *filter(None, paths)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may set its own."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="loomwork-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def table(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write df as Parquet (in a folder for each value of the columns `by`) into the shared folder and read it back: a cut of the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomwork/{uuid.uuid4().hex}/{name}"
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[id(out)] = path
    weakref.finalize(out, _folders.pop, id(out), None)
    if _scopes:
        _scopes[-1].append(out)
    return out


_folders: dict[int, str] = {}
_scopes: list[list[DataFrame]] = []


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete at the end all tables that table() makes inside, but for those that are given to the function that this yields."""
    made, kept = [], []
    _scopes.append(made)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _scopes.pop()
        discard(*(t for t in made if not any(t is k for k in kept)))
        if _scopes:
            _scopes[-1].extend(kept)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that table() returned. Nothing that still reads them may run afterwards; other DataFrames are left alone."""
    for df in tables:
        if df is not None and (path := _folders.pop(id(df), None)):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where.getParent(), True)


def need(df: DataFrame, *names: str) -> None:
    """Fail early, by name, if df lacks a column."""
    if lost := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lost)}")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt over all cores if it comes from fewer files and splits than there are cores: a small file may be a single task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = len(df.inputFiles()) < cores and df.rdd.getNumPartitions() <= cores
    return df.repartition(cores) if few and cores > 1 else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def text_crc32(text):
    """Unsigned CRC-32 of the UTF-8 bytes; null for null."""
    return F.crc32(text.cast("binary"))


def join_counted(left: DataFrame, right: DataFrame, on: list[str], count: str, total: int, how: str = "left") -> DataFrame:
    """left joined with right, which has each key of `on` once and in `count` the number of left's rows with it.

    Keys with a 64th of left's `total` rows or more (64 keys at most) are broadcast, so no task gets all rows of a hot key. With fewer
    than FEW_ROWS rows there is nothing to spread.
    """
    if total < FEW_ROWS:
        return left.join(right, on, how)
    from_ = max(2, -(-total // HOT_PARTS))
    hot = F.broadcast(right.filter(F.col(count) >= from_).withColumn("__hot", F.lit(True)))
    marked = left.join(hot, on, "left")
    cool = marked.filter("__hot is null").select(*left.columns).join(right.filter(F.col(count) < from_), on, how)
    return cool.unionByName(marked.filter("__hot").drop("__hot"))


def with_group(df: DataFrame, by: str, total: int, *facts: Column) -> DataFrame:
    """df with aggregates of each group of `by` (no nulls) beside every row, and `__size`, its number of rows.

    As a window would give them, but partly aggregated before the shuffle, and without all rows of a hot group in one task."""
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("__size"), *facts)
    return join_counted(df, sizes, [by], "__size", total)


def running(df: DataFrame, by: str, order: list[str], *sums: tuple[str, Column]) -> DataFrame:
    """df with running sums (name, value) within each group of `by`, in the order of the columns `order`, this row included.

    Rows are sorted into ranges of group and order. A range only continues the sums of its first group, so what it needs of the
    ranges before is one row: those rows are all that is broadcast, one for each range."""
    mark = df.repartitionByRange(by, *order).withColumn("__range", F.spark_partition_id())
    cut = table(mark, "ranges")
    own = cut.groupBy(by, "__range").agg(*(F.sum(value).alias(f"__{name}") for name, value in sums))
    first = cut.groupBy("__range").agg(F.min(by).alias(by))
    before = Window.partitionBy(by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = own.select(by, "__range", *(F.sum(f"__{name}").over(before).alias(f"__{name}") for name, _ in sums)).join(F.broadcast(first), [by, "__range"], "left_semi")
    so_far = Window.partitionBy("__range", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(F.broadcast(carried), [by, "__range"], "left")
    for name, value in sums:
        out = out.withColumn(name, F.sum(value).over(so_far) + F.coalesce(f"__{name}", F.lit(0)))
    return out.select(*df.columns, *(name for name, _ in sums))
