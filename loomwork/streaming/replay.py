"""Queues that are replayed: a stream's items are tried in order, those that fail stay in a retry table and are tried before newer ones."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Attempt = Callable[[DataFrame], DataFrame]
#: Columns that a queue adds to its items.
ADDED = "entered long, tries int, ok boolean"


class Queue:
    """Tables under a folder that all executors share.

    `tried` holds what each try of a micro-batch wrote; `ledger` names, for each micro-batch, the one try that counts. Its row is written
    last, so whatever happens before leaves no trace that a reader sees, and a micro-batch that is in it isn't tried again. What an
    attempt does to the world outside can happen twice, if a run ends between the two writes: items keep their keys for that."""

    def __init__(self, spark: SparkSession, folder: str, items: StructType, key: str, order: str, attempt: Attempt, most: int | None = None):
        """`attempt` gets a micro-batch's items, with entered and tries, sorted by key and turn, and adds a boolean column ok. `most`: so
        many failed items, the latest of each key, are kept; older ones are given up (ok null)."""
        self.spark, self.folder, self.items, self.key, self.order, self.attempt, self.most = spark, folder.rstrip("/"), items, key, order, attempt, most
        self.columns = [f.name for f in items]

    def _ledger(self) -> DataFrame:
        try:
            return self.spark.read.schema("run string, batch long").json(f"{self.folder}/ledger")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], "run string, batch long")

    def _tried(self, runs: list[tuple[int, str]] | None = None) -> DataFrame:
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in self.items), ADDED, "batch long, run string"])
        if runs is not None and not runs:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.folder}/tried/batch={b}/run={r}" for b, r in runs] if runs else [f"{self.folder}/tried"]
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/tried").parquet(*paths)

    def _last(self) -> list[tuple[int, str]]:
        """The newest micro-batch that counts."""
        row = self._ledger().agg(F.max_by(F.struct("batch", "run"), "batch").alias("last")).first()
        return [(row["last"]["batch"], row["last"]["run"])] if row["last"] is not None else []

    def pending(self) -> DataFrame:
        """The items that failed and are tried next, with entered (the micro-batch that they came in) and tries."""
        return self._tried(self._last()).filter("not ok").select(*self.columns, "entered", "tries")

    def flushed(self) -> DataFrame:
        """All items that succeeded, with entered, tries, and the micro-batch that did it."""
        return self._counted(F.col("ok"))

    def given_up(self) -> DataFrame:
        """All failed items that `most` left no room for."""
        return self._counted(F.col("ok").isNull())

    def _counted(self, which: Column) -> DataFrame:
        ledger = self._ledger()
        if ledger.isEmpty():
            return self._tried([]).select(*self.columns, "entered", "tries", "batch")
        return self._tried().join(F.broadcast(ledger), ["batch", "run"], "left_semi").filter(which).select(*self.columns, "entered", "tries", "batch")

    def flush(self, new: DataFrame, batch: int) -> None:
        """One micro-batch: older failures first, then what is new, each key's items in their order. A batch that counts already is left alone."""
        last = self._last()
        if last and last[0][0] >= batch:
            return
        work = new.select(*self.columns, F.lit(batch).cast("long").alias("entered"), F.lit(0).alias("tries")).unionByName(self.pending())
        lined = work.withColumn("tries", F.col("tries") + 1).repartition(self.key).sortWithinPartitions(self.key, "entered", self.order)
        done = self.attempt(lined).select(*self.columns, "entered", "tries", "ok")
        if self.most is not None:
            newest = F.row_number().over(Window.partitionBy(self.key, "ok").orderBy(F.desc("entered"), F.desc(self.order)))
            done = done.withColumn("ok", F.when(F.col("ok") | (newest <= self.most), F.col("ok")))
        run = uuid.uuid4().hex
        done.write.parquet(f"{self.folder}/tried/batch={batch}/run={run}")
        self._record(batch, run)

    def _record(self, batch: int, run: str) -> None:
        """From here on this run of the micro-batch counts."""
        self.spark.createDataFrame([(run,)], "run string").coalesce(1).write.mode("overwrite").json(f"{self.folder}/ledger/batch={batch}")

    def run(self, stream: DataFrame) -> None:
        """All that the stream has now, micro-batch by micro-batch. After a failure the same call goes on where the last one left off."""
        query = stream.writeStream.foreachBatch(self.flush).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
