"""Order-dependent computations within a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.core import Tables, query
from loomwork.functions.checks import light
from loomwork.operators.numbering import keep_first, numbered
from loomwork.operators.runs import numbered_runs


@query("previous_duplicate", "WITH p AS (SELECT doc_id, lag(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS seen FROM documents) SELECT doc_id, seen FROM p WHERE seen IS NOT NULL")
def previous_duplicate(t: Tables) -> DataFrame:
    """Of each repeated text the row before, not the first."""
    hashed = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    return hashed.withColumn("seen", F.lag("doc_id").over(Window.partitionBy("h").orderBy("doc_id"))).filter("seen is not null").select("doc_id", "seen")


@query(
    "near_duplicate_retake",
    r"""
WITH p AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 3 END AS take,
  lag(doc_id) OVER w AS seen, lag(CASE WHEN doc_id % 3 <> 0 THEN doc_id % 3 END) OVER w AS seen_take
  FROM documents WINDOW w AS (PARTITION BY source, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) ORDER BY doc_id))
SELECT doc_id, seen, NOT (take IS NOT NULL AND seen_take IS NOT NULL AND take <> seen_take) AS is_duplicate FROM p WHERE seen IS NOT NULL
""",
)
def near_duplicate_retake(t: Tables) -> DataFrame:
    """A speaker's text repeats an earlier one of the same words, whatever its case and spaces, unless both have a take number and
    those differ. Sources stand for speakers; texts are told apart by a hash."""
    take = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 3)
    own = Window.partitionBy("source", "said").orderBy("doc_id")
    said = t.documents.select("doc_id", "source", F.sha2(light(F.col("text")), 256).alias("said"), take.alias("take"))
    rows = said.select("doc_id", "take", F.lag("doc_id").over(own).alias("seen"), F.lag("take").over(own).alias("seen_take")).filter("seen is not null")
    return rows.select("doc_id", "seen", F.coalesce(F.col("take") == F.col("seen_take"), F.lit(True)).alias("is_duplicate"))


@query("dedup_keep_first", "SELECT min(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS copies FROM documents GROUP BY text")
def dedup_keep_first(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query("latest_per_key", "SELECT user_id, event_type, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id FROM events GROUP BY user_id, event_type")
def latest_per_key(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query(
    "history_window",
    """
WITH a AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
b AS (SELECT user_id, event_id, r, row_number() OVER (PARTITION BY user_id ORDER BY r DESC) AS back FROM a WHERE r <= 12 AND event_type <> 'error')
SELECT user_id, event_id, r AS place FROM b WHERE back <= 6
""",
)
def history_window(t: Tables) -> DataFrame:
    """Of each user's first twelve events the last six that aren't errors."""
    asc = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    first = t.events.select("user_id", "event_id", "event_type", asc.alias("place")).filter("place <= 12").filter("event_type <> 'error'")
    return keep_first(first, ["user_id"], ["place"], descending=True, n=6).select("user_id", "event_id", F.col("place").cast("long").alias("place"))


@query(
    "sessionize_gap",
    """
WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, CAST(count(*) AS BIGINT) AS n, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS seconds FROM s GROUP BY user_id, session
""",
)
def sessionize_gap(t: Tables) -> DataFrame:
    """A user's events with no gap of more than six hours are one session."""
    events = t.events.select("user_id", "event_id", "ts")
    rows = numbered_runs(events, "user_id", ["ts", "event_id"], F.col("ts"), lambda before, ts: before.isNull() | (ts - before > F.expr("INTERVAL 6 HOURS")), "session", t.cut)
    seconds = F.floor(F.unix_seconds(F.max("ts").cast("timestamp"))) - F.floor(F.unix_seconds(F.min("ts").cast("timestamp")))
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), seconds.cast("long").alias("seconds"))


@query(
    "voiced_segments",
    """
WITH f AS (SELECT user_id, ts, event_id, value >= 100 AS voiced FROM events),
g AS (SELECT *, CASE WHEN voiced AND NOT COALESCE(lag(voiced) OVER (PARTITION BY user_id ORDER BY ts, event_id), FALSE) THEN 1 ELSE 0 END AS starts FROM f),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM g)
SELECT user_id, CAST(segment AS BIGINT) AS segment, min(event_id) AS first_event, CAST(count(*) AS BIGINT) AS n FROM s WHERE voiced GROUP BY user_id, segment
""",
)
def voiced_segments(t: Tables) -> DataFrame:
    """Islands of events over a level."""
    events = t.events.select("user_id", "event_id", "ts", (F.col("value") >= 100).alias("voiced"))
    rows = numbered_runs(events, "user_id", ["ts", "event_id"], F.col("voiced"), lambda before, voiced: voiced & ~F.coalesce(before, F.lit(False)), "segment", t.cut)
    return rows.filter("voiced").groupBy("user_id", "segment").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n"))


@query("recent_unique_ring", "WITH l AS (SELECT user_id, max(event_id) AS last_id FROM events GROUP BY user_id) SELECT user_id, last_id FROM l ORDER BY last_id DESC LIMIT 50")
def recent_unique_ring(t: Tables) -> DataFrame:
    """The 50 users seen last."""
    return t.events.groupBy("user_id").agg(F.max("event_id").alias("last_id")).orderBy(F.desc("last_id")).limit(50)


@query("last_n_per_key", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 50")
def last_n_per_key(t: Tables) -> DataFrame:
    return keep_first(t.events.select("user_id", "event_id"), ["user_id"], ["event_id"], descending=True, n=50)


@query("batch_index", "SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 32) AS BIGINT) AS batch FROM documents")
def batch_index(t: Tables) -> DataFrame:
    """Batches of 32 in the order of keys."""
    return numbered(t.documents.select("doc_id"), "doc_id", "n").select("doc_id", F.floor((F.col("n") - 1) / 32).alias("batch"))


@query("sliding_frames", "WITH n AS (SELECT vec_id, len(embedding) AS n FROM embeddings), f AS (SELECT vec_id, n, UNNEST(range(0, n, 8)) AS start FROM n) SELECT vec_id, CAST(start AS INTEGER) AS start FROM f WHERE start + 16 < n")
def sliding_frames(t: Tables) -> DataFrame:
    """Starts of frames of 16 with a hop of 8; a frame that would end at the last sample isn't taken."""
    starts = F.filter(F.sequence(F.lit(0), F.size("embedding") - 1, F.lit(8)), lambda s: s + 16 < F.size("embedding"))
    return t.embeddings.select("vec_id", F.explode(starts).alias("start"))
