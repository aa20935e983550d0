"""Fixed windows that begin with a key's first event: a limiter for tables, and the same with state for streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "count long, until long"


class Limiter:
    """What is known of one key: events counted in the open window, and when that ends (microseconds)."""

    def __init__(self, count: int = 0, until: int | None = None):
        self.count, self.until = count, until

    def admit(self, at: int, limit: int, width: int) -> tuple[bool, int, int]:
        """(allowed, remaining, end of the window). A window ends at its end; blocked events aren't counted."""
        if self.until is None or self.until <= at:
            self.count, self.until = 1, at + width
            return True, limit - 1, self.until
        if self.count >= limit:
            return False, 0, self.until
        self.count += 1
        return True, limit - self.count, self.until


def limited(df: DataFrame, keys: list[str], ts: str, order: str, limit: str, seconds: int) -> DataFrame:
    """Add allowed, remaining and reset_at to every event, with the limit that its column `limit` has.

    Events are dealt by key and pass as a sorted stream of batches with one counter, so a key may have any number of them; the
    columns may be any, null keys are one key. ts must be a timestamp_ntz without nulls, `order` breaks ties."""
    work = df.withColumn("__at", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("__key", F.to_json(F.struct(*keys)))
    lined = work.repartition("__key").sortWithinPartitions("__key", "__at", order)
    names = [c for c in lined.columns if c not in ("__at", "__key")]

    def admit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, counter = None, Limiter()
        for rows in batches:
            out = []
            for k, at, most in zip(rows["__key"], rows["__at"], rows[limit], strict=True):
                if k != key:
                    key, counter = k, Limiter()
                out.append(counter.admit(int(at), int(most), seconds * 1_000_000))
            allowed, remaining, until = zip(*out, strict=True) if out else ((), (), ())
            yield rows[names].assign(allowed=list(allowed), remaining=list(remaining), __until=list(until))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", allowed boolean, remaining long, __until long"
    return lined.mapInPandas(admit, schema).withColumn("reset_at", F.timestamp_micros("__until").cast("timestamp_ntz")).drop("__until")


#: Admitted rows that a stream's key gives back at once.
ROWS_OUT = 20_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class WindowLimiter(StatefulProcessor):
    """One key's open window as state: a count, its end and a timer that forgets both when the watermark has passed the end.

    Of the rows of a micro-batch two numbers each are held until they are in order; a micro-batch is what the source's limits on files
    or bytes for a trigger allow."""

    def __init__(self, key: str, order: str, limit: int, seconds: int):
        self.key, self.order, self.limit, self.width = key, order, limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.window = handle, handle.getValueState("window", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [(r["at"].to_numpy(np.int64), r["turn"].to_numpy()) for r in rows if len(r)]
        if not held:
            return
        at, order = (np.concatenate(column) for column in zip(*held, strict=True))
        del held
        known = self.window.get()
        counter = Limiter(*known) if known is not None else Limiter()
        before = counter.until
        place = np.lexsort((order, at))
        for begin in range(0, len(place), ROWS_OUT):
            part = place[begin : begin + ROWS_OUT]
            allowed, remaining = np.empty(len(part), bool), np.empty(len(part), np.int64)
            for i, j in enumerate(part):
                allowed[i], remaining[i], _ = counter.admit(int(at[j]), self.limit, self.width)
            yield pd.DataFrame({self.key: key[0], self.order: order[part], "allowed": allowed, "remaining": remaining})
        self.window.update((counter.count, counter.until))
        if counter.until != before:
            if before is not None:
                self.handle.deleteTimer(-(-before // 1000))
            self.handle.registerTimer(-(-counter.until // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The window is over, so the next event opens a new one whether this is known or not."""
        self.window.clear()
        yield from ()


def limited_stream(events: DataFrame, key: str, ts: str, order: str, limit: int, seconds: int, late: str = "0 seconds") -> DataFrame:
    """The limiter over a stream with columns key, order and ts (timestamp_ntz): key, order, allowed and remaining.

    Events count in order of ts within a micro-batch, and of arrival between batches; those more than `late` behind the newest of
    earlier batches are dropped. A key's state is two numbers, forgotten when the newest event less `late` has reached its window's
    end: that changes no result, as a window that is over never counts again. A null key is a key."""
    spark, kind = events.sparkSession, {f.name: f.dataType.simpleString() for f in events.schema}
    spark.conf.set(PROVIDER, ROCKSDB)  # state with timers needs this store
    work = events.select(F.col(key).alias("who"), F.col(order).alias("turn"), F.col(ts).cast("timestamp").alias("time")).withWatermark("time", late).withColumn("at", F.unix_micros("time"))
    processor = WindowLimiter(key, order, limit, seconds)
    return work.groupBy("who").transformWithStateInPandas(processor, f"{key} {kind[key]}, {order} {kind[order]}, allowed boolean, remaining long", "Append", "EventTime")


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """who (the key), count, until: the state of a limiter's stream as its checkpoint has it."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "window").load()
    return state.select("key.who", "value.count", F.timestamp_micros("value.until").cast("timestamp_ntz").alias("until"))
