"""Joins of parents, children and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.core import Tables, query
from loomwork.operators.numbering import WIDTH


@query(
    "order_items_nested",
    """
SELECT o.o_orderkey, CAST(count(l.l_linenumber) AS BIGINT) AS n_items,
       COALESCE(string_agg(l.l_linenumber || ':' || p.p_name, ',' ORDER BY l.l_linenumber, p.p_name), '') AS items
FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey LEFT JOIN part p ON l.l_partkey = p.p_partkey GROUP BY o.o_orderkey
""",
)
def order_items_nested(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(t.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"), "left")
    items = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "p_name"))).alias("items"))
    nested = t.orders.select("o_orderkey").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    text = F.array_join(F.transform("items", lambda i: F.concat_ws(":", i["l_linenumber"], i["p_name"])), ",")
    return nested.select("o_orderkey", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce(text, F.lit("")).alias("items"))


@query(
    "recent_orders_with_items",
    """
WITH newest AS (SELECT * FROM orders WHERE o_custkey = 17 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20)
SELECT n.o_orderkey, l.l_linenumber, l.l_quantity FROM newest n LEFT JOIN lineitem l ON n.o_orderkey = l.l_orderkey
""",
)
def recent_orders_with_items(t: Tables) -> DataFrame:
    newest = t.orders.filter("o_custkey = 17").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20).select("o_orderkey")
    return newest.join(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "l_linenumber", "l_quantity")


@query(
    "conversation_counts",
    """
WITH c AS (SELECT DISTINCT conv_id FROM conversations), m AS (SELECT conv_id, count(*) AS n FROM conversations WHERE role <> 'system' GROUP BY conv_id)
SELECT c.conv_id, CAST(COALESCE(m.n, 0) AS BIGINT) AS n_messages FROM c LEFT JOIN m ON c.conv_id = m.conv_id
""",
)
def conversation_counts(t: Tables) -> DataFrame:
    counts = t.conversations.filter("role <> 'system'").groupBy("conv_id").agg(F.count("*").alias("n"))
    return t.conversations.select("conv_id").distinct().join(counts, "conv_id", "left").select("conv_id", F.coalesce("n", F.lit(0)).alias("n_messages"))


@query(
    "cross_manifest_duplicates",
    """
WITH old AS (SELECT text, max(doc_id) AS last_id FROM documents WHERE doc_id % 2 = 0 GROUP BY text)
SELECT d.doc_id, o.last_id AS seen_as FROM documents d JOIN old o ON d.text = o.text WHERE d.doc_id % 2 = 1
""",
)
def cross_manifest_duplicates(t: Tables) -> DataFrame:
    """Even documents stand for what was imported before; of equal ones the last is reported. Texts meet by their hash."""
    hashed = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    old = hashed.filter("doc_id % 2 = 0").groupBy("h").agg(F.max("doc_id").alias("seen_as"))
    return hashed.filter("doc_id % 2 = 1").join(old, "h").select("doc_id", "seen_as")


@query(
    "coalesce_lookup",
    """
SELECT d.doc_id, COALESCE(CASE WHEN l.toxic = 1 THEN 'toxic' END, CASE WHEN l.quality = 1 THEN 'good' END, CASE WHEN d.lang = 'en' THEN 'english' END, d.source) AS label
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""",
)
def coalesce_lookup(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id", "left")
    chain = F.coalesce(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 1, "good"), F.when(F.col("lang") == "en", "english"), F.col("source"))
    return joined.select("doc_id", chain.alias("label"))


@query(
    "same_label_pairs",
    """
WITH next AS (SELECT vec_id, label, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS n, min(vec_id) OVER (PARTITION BY label) AS f, count(*) OVER (PARTITION BY label) AS k FROM embeddings)
SELECT vec_id AS anchor, COALESCE(n, f) AS positive, label FROM next WHERE k > 1
""",
)
def same_label_pairs(t: Tables) -> DataFrame:
    """For each anchor one other member of its group: the next, and for the last the first. No group is paired with itself. Keys are
    ordered within ranges; a range's last key gets the next range's first, so a large group isn't ordered in one task."""
    rows = t.embeddings.select("vec_id", "label", F.floor(F.col("vec_id") / WIDTH).alias("range"))
    group = Window.partitionBy("label")
    ranges = rows.groupBy("label", "range").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    ranges = ranges.select("label", "range", F.lead("low").over(group.orderBy("range")).alias("after"), F.min("low").over(group).alias("first"), F.sum("n").over(group).alias("k"))
    near = rows.withColumn("next", F.lead("vec_id").over(Window.partitionBy("label", "range").orderBy("vec_id")))
    return near.join(ranges, ["label", "range"]).filter("k > 1").select(F.col("vec_id").alias("anchor"), F.coalesce("next", "after", "first").alias("positive"), "label")


RESULTS_SQL = """
WITH results AS (
  SELECT l_suppkey AS model, l_returnflag AS slice, round(CAST(l_discount AS DOUBLE) * 100 + CAST(l_tax AS DOUBLE) * 100, 6) AS wer, CAST(l_quantity AS BIGINT) AS n,
         l_orderkey * 8 + l_linenumber AS run FROM lineitem
)"""


def results(t: Tables) -> DataFrame:
    """Result rows made from line items: supplier as model, return flag as slice, discount and tax as error rate, quantity as sample size."""
    wer = F.round(F.col("l_discount") * 100 + F.col("l_tax") * 100, 6)
    return t.lineitem.select(F.col("l_suppkey").alias("model"), F.col("l_returnflag").alias("slice"), wer.alias("wer"), F.col("l_quantity").cast("long").alias("n"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("run"))


@query(
    "gate_vs_baseline",
    RESULTS_SQL
    + """, base AS (SELECT min(wer) AS base FROM results WHERE model = 1 AND slice = 'R'), best AS (SELECT model, min(wer) AS wer FROM results WHERE slice = 'R' GROUP BY model)
SELECT model, wer, round(wer - base, 6) AS delta, COALESCE(wer < 31.49, FALSE) AS beats_greedy, COALESCE(wer < 30.44, FALSE) AS beats_beam, COALESCE(wer <= 17 AND wer - base <= 5, FALSE) AS retained
FROM best LEFT JOIN base ON TRUE
""",
)
def gate_vs_baseline(t: Tables) -> DataFrame:
    """The best rate of model 1 is the baseline of all models; without one no model is retained."""
    own = results(t).filter("slice = 'R'")
    base = own.filter("model = 1").agg(F.min("wer").alias("base"))
    best = own.groupBy("model").agg(F.min("wer").alias("wer")).withColumn("base", base.scalar())
    delta = F.col("wer") - F.col("base")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return best.select("model", "wer", F.round(delta, 6).alias("delta"), yes(F.col("wer") < 31.49).alias("beats_greedy"), yes(F.col("wer") < 30.44).alias("beats_beam"), yes((F.col("wer") <= 17) & (delta <= 5)).alias("retained"))
