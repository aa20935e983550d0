"""Runs within a group's order (sessions, islands), where a group may be of any size: ranges of the order, not groups, are what tasks hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered_runs(df: DataFrame, by: str, order: list[str], value: Column, starts: Callable[[Column, Column], Column], name: str, cut) -> DataFrame:
    """Add `name`: how many runs of the group `by` have begun up to a row, in the order of the columns `order` (without ties).

    starts(before, value) says whether a row begins a run, by its value and that of the group's row before, which is null for the
    first. A null group is a group. Rows are dealt to ranges of group and order, so a hot group is in many tasks. What a range needs of
    those before it is the last value and the number of runs of its own first group: two rows for each range are broadcast."""
    ranged = cut(df.withColumn("__value", value).repartitionByRange(by, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    edges = ranged.groupBy("__range").agg(F.max_by(F.struct(F.col(by).alias("by"), F.col("__value").alias("value")), F.struct(by, *order)).alias("last"), F.min(F.struct(F.col(by).alias("by"))).alias("first"))
    before = F.lag("last").over(Window.orderBy("__range"))  # a row for each range
    carried = edges.select(F.col("__range").alias("__in"), "first", before.alias("__last"))
    own = Window.partitionBy("__range", by).orderBy(*order)
    rows = ranged.join(F.broadcast(carried.select("__in", "__last")), F.col("__range") == F.col("__in"))
    first = F.row_number().over(own) == 1
    prior = F.when(~first, F.lag("__value").over(own)).when(F.col("__last.by").eqNullSafe(F.col(by)) & F.col("__last").isNotNull(), F.col("__last.value"))
    marked = rows.withColumn("__fresh", F.coalesce(starts(prior, F.col("__value")), F.lit(False)).cast("long"))
    marked = cut(marked.select(*df.columns, "__range", "__fresh"), "starts")
    sums = marked.groupBy(F.col(by).alias("__by"), F.col("__range").alias("__at")).agg(F.sum("__fresh").alias("__n"))
    so_far = F.sum("__n").over(Window.partitionBy("__by").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    begun = sums.withColumn("__begun", so_far).join(F.broadcast(carried), (F.col("__at") == F.col("__in")) & F.col("__by").eqNullSafe(F.col("first.by"))).select("__at", "__by", "__begun")
    total = F.sum("__fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("__begun", F.lit(0))
    met = marked.join(F.broadcast(begun), (F.col("__range") == F.col("__at")) & F.col(by).eqNullSafe(F.col("__by")), "left")
    return met.withColumn(name, total).select(*df.columns, name)
