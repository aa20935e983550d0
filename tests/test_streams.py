"""Streams with state: windows that expire, keys of any size, queues that are replayed."""

from __future__ import annotations

import datetime
import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loomwork.streaming import limits
from loomwork.streaming.replay import Queue
from loomwork.streaming.windows import run_to_table

DAY0 = datetime.datetime(2024, 1, 1)
SCHEMA = "k string, id long, ts timestamp_ntz"


def stream_of(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def add(spark, folder, rows):
    spark.createDataFrame([(k, i, DAY0 + datetime.timedelta(seconds=s)) for k, i, s in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def test_windows_expire(spark, tmp_path):
    """Batch after batch: state is dropped once the newest event has passed a window's end, and results are as if it never had been."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    batches = [
        [("a", 1, 0), ("a", 2, 10), ("a", 3, 20), ("b", 4, 30), (None, 5, 40)],
        [("c", 6, 100), ("c", 7, 99)],
        [("a", 8, 130), ("b", 9, 131), ("a", 10, 132), ("a", 11, 133)],
        [("d", 12, 500)],
    ]
    left = []
    for rows in batches:
        add(spark, folder, rows)
        got = run_to_table(limits.limited_stream(stream_of(spark, folder), "k", "ts", "id", 2, 60), out)
        left.append({r.who: (r["count"], (r.until - DAY0).seconds) for r in limits.open_windows(spark, f"{out}/checkpoint").collect()})
    assert left == [{"a": (2, 60), "b": (1, 90), None: (1, 100)}, {"c": (2, 159)}, {"a": (2, 190), "b": (1, 191), "c": (2, 159)}, {"d": (1, 560)}]
    allowed = {r.id: (r.allowed, r.remaining) for r in got.collect()}
    assert allowed == {1: (True, 1), 2: (True, 0), 3: (False, 0), 4: (True, 1), 5: (True, 1), 6: (True, 0), 7: (True, 1), 8: (True, 1), 9: (True, 1), 10: (True, 0), 11: (False, 0), 12: (True, 1)}


def test_late_events(spark, tmp_path):
    """Events behind the watermark are dropped, those within `late` of the newest still count."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    for rows in ([("a", 1, 1000)], [("a", 2, 950), ("a", 3, 1001)], [("a", 4, 100)]):
        add(spark, folder, rows)
        got = run_to_table(limits.limited_stream(stream_of(spark, folder), "k", "ts", "id", 9, 60, late="100 seconds"), out)
    assert {r.id for r in got.collect()} == {1, 2, 3}


def test_a_key_with_many_events():
    """A million rows of one key: two numbers are held for each, and rows come out in parts."""

    class Handle:
        def __init__(self):
            self.value, self.timers = None, set()

        def getValueState(self, name, schema):
            return self

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def registerTimer(self, at):
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    handle, n = Handle(), 1_000_000
    worker = limits.WindowLimiter("k", "id", 5, 3600)
    worker.init(handle)

    def rows():
        for begin in range(n, 0, -10_000):  # the newest first
            ids = np.arange(begin - 10_000, begin)
            yield pd.DataFrame({"who": "x", "turn": ids, "at": ids * 1_000_000, "text": "y" * 200})

    tracemalloc.start()
    allowed = parts = 0
    for part in worker.handleInputRows(("x",), rows(), None):
        allowed, parts = allowed + int(part["allowed"].sum()), parts + 1
        assert len(part) <= limits.ROWS_OUT
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert parts == n // limits.ROWS_OUT and allowed == 5 * -(-n // 3600)
    assert handle.timers == {(999_999 // 3600 + 1) * 3_600_000} and handle.value[1] == (999_999 // 3600 + 1) * 3_600_000_000
    assert peak < 64 * n  # bytes


ITEMS = "k string, id long, until int"


def queue_of(spark, folder, most=None):
    """Items fail until they have been tried `until` times."""
    schema = spark.createDataFrame([], ITEMS).schema
    return Queue(spark, str(folder), schema, "k", "id", lambda rows: rows.withColumn("ok", F.col("tries") >= F.col("until")), most)


def arrive(spark, folder, n, rows):
    spark.createDataFrame(rows, ITEMS).coalesce(1).write.parquet(f"{folder}/in/batch={n}")
    return spark.readStream.schema(ITEMS).parquet(f"{folder}/in/batch=[0-{n}]")


BATCHES = [[("a", 1, 1), ("a", 2, 3), ("a", 3, 9), ("b", 4, 2)], [("a", 5, 9), ("b", 6, 1), (None, 7, 2)], [("a", 0, 9), ("c", 8, 1)]]


def waiting(queue):
    rows = sorted(queue.pending().collect(), key=lambda r: (str(r.k), r.entered, r.id))
    return [(r.k, r.id, r.entered, r.tries) for r in rows]


def done(queue):
    return sorted((r.id, r.entered, r.tries, r.batch) for r in queue.flushed().collect())


WAITING = [[("a", 2, 0, 1), ("a", 3, 0, 1), ("b", 4, 0, 1)], [(None, 7, 1, 1), ("a", 2, 0, 2), ("a", 3, 0, 2), ("a", 5, 1, 1)], [("a", 3, 0, 3), ("a", 5, 1, 2), ("a", 0, 2, 1)]]
DONE = [[(1, 0, 1, 0)], [(1, 0, 1, 0), (4, 0, 2, 1), (6, 1, 1, 1)], [(1, 0, 1, 0), (2, 0, 3, 2), (4, 0, 2, 1), (6, 1, 1, 1), (7, 1, 2, 2), (8, 2, 1, 2)]]


def test_replay_keeps_order(spark, tmp_path):
    queue = queue_of(spark, tmp_path / "q")
    assert waiting(queue) == [] and done(queue) == []
    for n, rows in enumerate(BATCHES):
        queue.run(arrive(spark, tmp_path, n, rows))
        assert waiting(queue) == WAITING[n] and done(queue) == DONE[n]
    assert queue.given_up().count() == 0


def test_items_reach_the_attempt_in_order(spark, tmp_path):
    """Within a key older items come first, whatever micro-batch they are from."""
    seen = tmp_path / "seen"
    seen.mkdir()

    def attempt(rows):
        def each(parts):
            for p in parts:
                for k, group in p.groupby("k", dropna=False):
                    with open(f"{seen}/{k}", "a") as f:
                        f.write("".join(f"{i} " for i in group["id"]))
                yield p.assign(ok=False)

        return rows.mapInPandas(each, f"{ITEMS}, entered long, tries int, ok boolean")

    queue = Queue(spark, str(tmp_path / "q"), spark.createDataFrame([], ITEMS).schema, "k", "id", attempt)
    for n, rows in enumerate(BATCHES):
        queue.flush(spark.createDataFrame(rows, ITEMS).repartition(3), n)
    assert (seen / "a").read_text().split() == "1 2 3 1 2 3 5 1 2 3 5 0".split()


def test_failures_change_nothing(spark, tmp_path, monkeypatch):
    """A run that ends between its write and the ledger's, and a micro-batch that comes again after it."""
    queue, record, broken = queue_of(spark, tmp_path / "q"), Queue._record, []

    def failing(self, batch, run):
        if batch not in broken:
            broken.append(batch)
            raise RuntimeError("stopped here")
        record(self, batch, run)

    monkeypatch.setattr(Queue, "_record", failing)
    for n, rows in enumerate(BATCHES):
        stream = arrive(spark, tmp_path, n, rows)
        before = waiting(queue), done(queue)
        try:
            queue.run(stream)
            raise AssertionError("no failure")
        except Exception as e:
            assert "stopped here" in str(e)
        assert (waiting(queue), done(queue)) == before
        queue.run(stream)
        assert waiting(queue) == WAITING[n] and done(queue) == DONE[n]
        queue.flush(spark.createDataFrame(rows, ITEMS), n)  # recorded, but the stream didn't come to know
        assert waiting(queue) == WAITING[n] and done(queue) == DONE[n]


def test_most(spark, tmp_path):
    queue = queue_of(spark, tmp_path / "q", most=2)
    for n, rows in enumerate(BATCHES):
        queue.flush(spark.createDataFrame(rows, ITEMS), n)
    assert [x[1] for x in waiting(queue)] == [5, 0]
    assert sorted((r.id, r.batch) for r in queue.given_up().collect()) == [(2, 1), (3, 2)]
