"""Event-time windows over streams or tables. An addition: the work that this engine rebuilds has only the windows of limits.py."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(events: DataFrame, ts: str, by: str, width: str, slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Events and their values by tumbling or sliding window; on a stream events up to `late` behind the newest still count."""
    frame = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(frame.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def session_counts(events: DataFrame, ts: str, by: str, gap: str, late: str = "2 hours") -> DataFrame:
    """Events by session: a gap without events ends one."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all that is there now, with its checkpoint beside its output, and read the output.

    Both lie under `folder`, which all executors must share; after a failure the same call goes on where the last left off."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
