"""Row numbers over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Key values that share a window; a table has one bucket row for each such range.
WIDTH = 1 << 16


def numbered(df: DataFrame, key: str, name: str, width: int = WIDTH) -> DataFrame:
    """Add `name`: 1, 2, ... in the order of `key`, a whole-number column without nulls.

    Rows are counted in ranges of `width` key values; only those counts pass through one task."""
    bucketed = df.withColumn("__bucket", F.floor(F.col(key) / width))
    sizes = bucketed.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy("__bucket").orderBy(key))
    return bucketed.withColumn("__own", own).join(starts, "__bucket").withColumn(name, F.col("__start") + F.col("__own")).drop("__bucket", "__own", "__start")


def keep_first(df: DataFrame, by: list[str], order: list[str], descending: bool = False, n: int = 1) -> DataFrame:
    """The first n rows of each group in an order that must be total."""
    way = [F.desc(c) if descending else F.asc(c) for c in order]
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*way))).filter(F.col("__rank") <= n).drop("__rank")
