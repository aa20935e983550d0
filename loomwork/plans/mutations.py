"""Changes of tables as rewrites: upserts, deletions and state transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.core import Tables, query


@query(
    "upsert_increment",
    """
WITH cart AS (SELECT l_partkey AS part, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_partkey), add AS (SELECT l_partkey AS part, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey)
SELECT COALESCE(c.part, a.part) AS part, COALESCE(c.q, 0) + COALESCE(a.q, 0) AS quantity FROM cart c FULL OUTER JOIN add a ON c.part = a.part
""",
)
def upsert_increment(t: Tables) -> DataFrame:
    """What is added (returned lines) onto what is there (open lines): pre-summed on both sides, then one sum of the union."""
    rows = t.lineitem.filter(F.col("l_returnflag").isin("N", "R"))
    return rows.groupBy(F.col("l_partkey").alias("part")).agg(F.sum("l_quantity").alias("quantity"))


@query(
    "upsert_latest",
    """
WITH keyed AS (SELECT CASE WHEN user_id % 5 <> 0 THEN user_id END AS owner, event_type AS scope, event_id, value FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY owner, scope ORDER BY event_id DESC) AS k FROM keyed)
SELECT owner, scope, event_id, value FROM r WHERE k = 1
""",
)
def upsert_latest(t: Tables) -> DataFrame:
    """The newest value for each owner and scope; a missing owner is one key, equal to itself."""
    owner = F.when(F.col("user_id") % 5 != 0, F.col("user_id"))
    latest = t.events.groupBy(owner.alias("owner"), F.col("event_type").alias("scope")).agg(F.max_by(F.struct("event_id", "value"), "event_id").alias("l"))
    return latest.select("owner", "scope", "l.event_id", "l.value")


@query("scd_active_flag", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS is_active FROM events WHERE event_type = 'signup'")
def scd_active_flag(t: Tables) -> DataFrame:
    """Each new enrolment ends the one before."""
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))) == 1
    return t.events.filter("event_type = 'signup'").select("event_id", "user_id", newest.alias("is_active"))


@query(
    "stock_after_orders",
    "SELECT p.p_partkey, p.p_size * 100 - COALESCE(o.q, 0) AS stock FROM part p LEFT JOIN (SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY l_partkey) o ON p.p_partkey = o.l_partkey",
)
def stock_after_orders(t: Tables) -> DataFrame:
    taken = t.lineitem.groupBy("l_partkey").agg(F.sum("l_quantity").cast("long").alias("taken"))
    left = t.part.join(taken, F.col("p_partkey") == F.col("l_partkey"), "left")
    return left.select("p_partkey", (F.col("p_size") * 100 - F.coalesce("taken", F.lit(0))).alias("stock"))


@query(
    "stock_shortage",
    "SELECT l.l_orderkey, bool_or(p.p_size < l.l_quantity) AS short FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY l.l_orderkey",
)
def stock_shortage(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t.part.select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("l_orderkey").agg(F.bool_or(F.col("p_size") < F.col("l_quantity")).alias("short"))


@query(
    "idempotent_transition",
    "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 3 = 0 THEN 'F' ELSE o_orderstatus END AS status, o_orderstatus <> 'F' AND o_orderkey % 3 = 0 AS changed FROM orders",
)
def idempotent_transition(t: Tables) -> DataFrame:
    """Payments of every third order arrive, each twice; an order that is paid already doesn't change."""
    notices = t.orders.filter("o_orderkey % 3 = 0").select("o_orderkey")
    paid = notices.unionByName(notices).distinct().withColumn("paid", F.lit(True))
    changed = F.coalesce("paid", F.lit(False)) & (F.col("o_orderstatus") != "F")
    return t.orders.join(paid, "o_orderkey", "left").select("o_orderkey", F.when(changed, "F").otherwise(F.col("o_orderstatus")).alias("status"), changed.alias("changed"))


@query(
    "cascade_delete",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')",
)
def cascade_delete(t: Tables) -> DataFrame:
    gone = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber").join(gone, "l_orderkey", "left_anti")


@query(
    "cache_refresh",
    "SELECT d.doc_id, (l.quality IS NOT NULL AND l.quality = 1) AS was_cached, md5(d.text) AS cached FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def cache_refresh(t: Tables) -> DataFrame:
    """Documents of good quality are cached; only the others are computed."""
    fresh = t.labels.filter("quality = 1").select("doc_id")
    rows = t.documents.select("doc_id", F.md5("text").alias("cached"))
    kept = rows.join(fresh, "doc_id", "left_semi").withColumn("was_cached", F.lit(True))
    return kept.unionByName(rows.join(fresh, "doc_id", "left_anti").withColumn("was_cached", F.lit(False))).select("doc_id", "was_cached", "cached")


@query("set_or_delete", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 THEN 9.0 ELSE l_quantity END AS quantity FROM lineitem WHERE l_linenumber <> 1")
def set_or_delete(t: Tables) -> DataFrame:
    """First lines are set to 0, which deletes them, second lines to 9."""
    wanted = F.when(F.col("l_linenumber") == 1, 0.0).when(F.col("l_linenumber") == 2, 9.0)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.coalesce(wanted, "l_quantity").alias("quantity")).filter("quantity > 0")
