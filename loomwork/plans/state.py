"""Stateful event logic: limits, stage orders, replays, and early stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork import core
from loomwork.core import Tables, query
from loomwork.streaming.limits import limited, limited_stream, open_windows
from loomwork.streaming.replay import Queue
from loomwork.streaming.windows import run_to_table, session_counts, window_counts

LIMIT, DAY = 3, 24 * 3600
#: Events a day that each kind of route allows.
ROUTES = {"click": 4, "error": 1, "purchase": 2, "signup": 1, "view": 3}


def _limits(key: str, limit: str) -> str:
    return f"""
WITH RECURSIVE e AS (SELECT *, {key} AS k, {limit} AS most FROM events),
opened AS (SELECT k, min(ts) AS s FROM e GROUP BY k UNION ALL SELECT o.k, min(e.ts) FROM opened o JOIN e ON e.k = o.k AND e.ts >= o.s + INTERVAL 24 HOUR GROUP BY o.k, o.s),
placed AS (SELECT e.event_id, e.ts, e.k, e.most, max(o.s) AS s FROM e JOIN opened o ON o.k = e.k AND o.s <= e.ts GROUP BY e.event_id, e.ts, e.k, e.most),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k, s ORDER BY ts, event_id) AS r FROM placed)
SELECT event_id, r <= most AS allowed, CAST(greatest(most - r, 0) AS BIGINT) AS remaining"""


@query("rate_limit", _limits("user_id", str(LIMIT)) + ", s + INTERVAL 24 HOUR AS reset_at FROM ranked")
def rate_limit(t: Tables) -> DataFrame:
    """Three events a day for each user, in windows that begin with the first."""
    rows = t.events.select("event_id", "ts", "user_id", F.lit(LIMIT).alias("most"))
    return limited(rows, ["user_id"], "ts", "event_id", "most", DAY).select("event_id", "allowed", "remaining", "reset_at")


@query("rate_limit_routes", _limits("user_id || ':' || event_type", "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ROUTES.items()) + " END") + " FROM ranked")
def rate_limit_routes(t: Tables) -> DataFrame:
    """Each kind of route has a limit of its own."""
    most = F.create_map(*(F.lit(x) for p in ROUTES.items() for x in p))[F.col("event_type")]
    return limited(t.events.select("event_id", "ts", "user_id", "event_type", most.alias("most")), ["user_id", "event_type"], "ts", "event_id", "most", DAY).select("event_id", "allowed", "remaining")


def _events_stream(t: Tables) -> DataFrame:
    """The last letter is a pattern, as a stream reads folders and patterns but no single file."""
    return t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parque[t]")


@query("rate_limit_stream", _limits("user_id", str(LIMIT)) + " FROM ranked")
def rate_limit_stream(t: Tables) -> DataFrame:
    """The limiter with state, over the events as a stream."""
    return run_to_table(limited_stream(_events_stream(t), "user_id", "ts", "event_id", LIMIT, DAY), core.scratch(t.spark, "rate_limit_stream")).select("event_id", "allowed", "remaining")


@query(
    "rate_limit_open_windows",
    _limits("user_id", str(LIMIT)).rsplit("SELECT", 1)[0]
    + f"""SELECT k AS user_id, s + INTERVAL 24 HOUR AS until, CAST(least(count(*), {LIMIT}) AS BIGINT) AS count FROM ranked
GROUP BY k, s HAVING s + INTERVAL 24 HOUR > (SELECT max(ts) FROM events)""",
)
def rate_limit_open_windows(t: Tables) -> DataFrame:
    """What the limiter's stream still knows when it has read all events: the windows that are open at the newest one."""
    folder = core.scratch(t.spark, "rate_limit_stream")
    run_to_table(limited_stream(_events_stream(t), "user_id", "ts", "event_id", LIMIT, DAY), folder)
    return open_windows(t.spark, f"{folder}/checkpoint").select(F.col("who").alias("user_id"), "until", "count")


@query("window_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def hourly_counts(t: Tables) -> DataFrame:
    """An addition: events by hour."""
    return window_counts(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "session_counts",
    """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT min(ts) AS start, user_id, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, session
""",
)
def sessions(t: Tables) -> DataFrame:
    """An addition: events by session."""
    return session_counts(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "30 minutes").withColumn("start", F.col("start").cast("timestamp_ntz"))


STAGES = ("signup", "view", "click", "purchase")


@query(
    "stage_order_check",
    "WITH f AS (SELECT user_id, " + ", ".join(f"min(event_id) FILTER (WHERE event_type = '{s}') AS {s}" for s in STAGES) + " FROM events GROUP BY user_id) SELECT user_id, COALESCE("
    + " AND ".join(f"{a} < {b}" for a, b in zip(STAGES, STAGES[1:], strict=False)) + ", FALSE) AS in_order FROM f",
)
def stage_order_check(t: Tables) -> DataFrame:
    """Whether each user's stages first came in order; one that never came breaks it."""
    first = t.events.groupBy("user_id").agg(*(F.min(F.when(F.col("event_type") == s, F.col("event_id"))).alias(s) for s in STAGES))
    chain = F.lit(True)
    for a, b in zip(STAGES, STAGES[1:], strict=False):
        chain = chain & (F.col(a) < F.col(b))
    return first.select("user_id", F.coalesce(chain, F.lit(False)).alias("in_order"))


@query(
    "replay_split",
    "SELECT event_id, event_type <> 'error' AS flushed, CASE WHEN event_type = 'error' THEN CAST(row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY event_id) AS INTEGER) END AS place FROM events",
)
def replay_split(t: Tables) -> DataFrame:
    """A user's queue is replayed in order; errors stand for what fails, and keep their order in what remains."""
    failed = F.col("event_type") == "error"
    place = F.row_number().over(Window.partitionBy("user_id", failed).orderBy("event_id"))
    return t.events.select("event_id", (~failed).alias("flushed"), F.when(failed, place).alias("place"))


@query(
    "replay_stream",
    """
WITH e AS (SELECT event_id, user_id, event_id % 4 AS entered, CASE WHEN event_type = 'error' THEN event_id // 4 % 4 ELSE 0 END AS failures FROM events),
done AS (SELECT *, entered + failures <= 3 AS flushed FROM e)
SELECT event_id, flushed, CAST(CASE WHEN flushed THEN failures + 1 ELSE 4 - entered END AS INTEGER) AS tries, CASE WHEN flushed THEN entered + failures END AS batch,
       CASE WHEN NOT flushed THEN CAST(row_number() OVER (PARTITION BY user_id, flushed ORDER BY entered, event_id) AS INTEGER) END AS place FROM done
""",
)
def replay_stream(t: Tables) -> DataFrame:
    """The events as a queue of each user in four micro-batches, with a retry table between them. Errors stand for what fails: up to
    three times, by their number."""
    folder = core.scratch(t.spark, "replay")
    events = t.events.select("event_id", "user_id", "event_type")
    for i in range(4):
        events.filter(F.col("event_id") % 4 == i).write.mode("append").parquet(f"{folder}/arrived/slice={i}")
    fails = (F.col("event_type") == "error") & (F.col("tries") <= F.floor(F.col("event_id") / 4) % 4)
    queue = Queue(t.spark, f"{folder}/queue", events.schema, "user_id", "event_id", lambda rows: rows.withColumn("ok", ~fails))
    for i in range(4):  # each run goes on where the one before ended
        queue.run(t.spark.readStream.schema(events.schema).parquet(f"{folder}/arrived/slice=[0-{i}]"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("entered", "event_id"))
    waiting = queue.pending().select("event_id", F.lit(False).alias("flushed"), "tries", F.lit(None).cast("long").alias("batch"), place.alias("place"))
    return queue.flushed().select("event_id", F.lit(True).alias("flushed"), "tries", "batch", F.lit(None).cast("int").alias("place")).unionByName(waiting)


ACCEPTED = 200


@query(
    "accept_skip_counts",
    f"""
WITH a AS (SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars BETWEEN 500 AND 28000 ORDER BY doc_id LIMIT {ACCEPTED}), stop AS (SELECT count(*) AS n, max(doc_id) AS last FROM a)
SELECT CAST(s.n AS BIGINT) AS accepted, CAST((SELECT count(*) FROM documents WHERE doc_id <= s.last OR s.n < {ACCEPTED}) - s.n AS BIGINT) AS skipped FROM stop s
""",
)
def accept_skip_counts(t: Tables) -> DataFrame:
    """Rows are read in order until 200 are accepted, which is the feature; those passed over are counted."""
    fits = (F.col("lang") == "en") & F.col("n_chars").between(500, 28000)
    stop = t.documents.filter(fits).select("doc_id").orderBy("doc_id").limit(ACCEPTED).agg(F.count("*").alias("accepted"), F.max("doc_id").alias("last"))
    seen = t.documents.select("doc_id").join(F.broadcast(stop), (F.col("doc_id") <= F.col("last")) | (F.col("accepted") < ACCEPTED))
    return seen.groupBy("accepted").agg(F.count("*").alias("seen")).select("accepted", (F.col("seen") - F.col("accepted")).alias("skipped"))
