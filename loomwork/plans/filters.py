"""Projections, filters and validity checks."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.core import Tables, query
from loomwork.functions import checks
from loomwork.operators.filters import filtered

CLOCK = "2024-01-15 00:00:00"


@query("optional_filter", "SELECT p_partkey, p_name, p_brand FROM part WHERE p_brand = 'Brand#11'")
def optional_filter(t: Tables) -> DataFrame:
    """A brand is asked for, a type isn't."""
    return filtered(t.part, p_brand="Brand#11", p_type=None).select("p_partkey", "p_name", "p_brand")


@query("icontains_filter", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def icontains_filter(t: Tables) -> DataFrame:
    return t.part.filter(checks.icontains(F.col("p_name"), "RiNg")).select("p_partkey", "p_name")


@query("array_has", "SELECT p_partkey, p_type FROM part WHERE list_contains(string_split(p_type, ' '), 'PROMO')")
def array_has(t: Tables) -> DataFrame:
    return t.part.filter(F.array_contains(F.split("p_type", " "), "PROMO")).select("p_partkey", "p_type")


@query("not_null_filter", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL")
def not_null_filter(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").filter(F.col("quality").isNotNull()).select("doc_id", "quality")


@query("in_list", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (1, 5, 32, 100, 103, 640)")
def in_list(t: Tables) -> DataFrame:
    """Entries that aren't keys are dropped from the list, and it is cut at 50."""
    asked = ["1", "5", "x7", "32", "", "100", "103", "640"]
    return t.orders.filter(F.col("o_orderkey").isin([int(x) for x in asked if x.isdigit()][:50])).select("o_orderkey", "o_orderstatus")


@query("owner_or", "SELECT event_id, user_id, event_type FROM events WHERE user_id = 7 OR event_type = 'signup'")
def owner_or(t: Tables) -> DataFrame:
    return checks.owned(t.events, user_id=7, event_type="signup").select("event_id", "user_id", "event_type")


@query("visible_rows", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS owner FROM orders WHERE o_orderstatus = 'P' OR o_custkey = 17")
def visible_rows(t: Tables) -> DataFrame:
    """Pending orders stand for rows without an owner, which all may see."""
    owner = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey"))
    return t.orders.select("o_orderkey", owner.alias("owner")).filter(F.col("owner").isNull() | (F.col("owner") == 17))


@query("range_filter", "SELECT doc_id, n_chars FROM documents WHERE n_chars / 1000.0 BETWEEN 0.5 AND 28.0")
def range_filter(t: Tables) -> DataFrame:
    """Thousands of characters stand for seconds."""
    return t.documents.filter((F.col("n_chars") / 1000).between(0.5, 28.0)).select("doc_id", "n_chars")


@query("vote_filter", "SELECT doc_id, quality, toxic FROM labels WHERE COALESCE(quality * 2, 0) >= 2 AND COALESCE(toxic, 0) = 0")
def vote_filter(t: Tables) -> DataFrame:
    return t.labels.filter(checks.enough_votes((F.col("quality") * 2).cast("string"), F.col("toxic").cast("string"))).select("doc_id", "quality", "toxic")


@query("min_text_length", r"SELECT doc_id FROM documents WHERE length(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) >= 2")
def min_text_length(t: Tables) -> DataFrame:
    return t.documents.filter(F.length(checks.light(F.col("text"))) >= 2).select("doc_id")


@query("semi_join_validated", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join_validated(t: Tables) -> DataFrame:
    return t.documents.join(t.labels.filter("quality = 1"), "doc_id", "left_semi").select("doc_id", "source")


@query(
    "meaningful_change",
    r"""
WITH turns AS (
  SELECT conv_id, turn, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS now,
         trim(regexp_replace(lower(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)), '\s+', ' ', 'g')) AS before FROM conversations
), words AS (SELECT *, string_split(now, ' ') AS b, string_split(before, ' ') AS a FROM turns WHERE before <> '' AND now <> '' AND before <> now)
SELECT conv_id, turn, CAST((SELECT count(*) FROM (SELECT UNNEST(range(1, greatest(len(a), len(b)) + 1)) AS i) WHERE a[i] IS DISTINCT FROM b[i]) AS BIGINT) AS words_changed FROM words
""",
)
def meaningful_change(t: Tables) -> DataFrame:
    """Each turn as a correction of the one before."""
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = t.conversations.select("conv_id", "turn", F.col("text").alias("now"), before.alias("before"))
    return pairs.filter(checks.meaningful_change(F.col("before"), F.col("now"))).select("conv_id", "turn", checks.words_changed(checks.light(F.col("before")), checks.light(F.col("now"))).cast("long").alias("words_changed"))


@query("pii_flag", rf"SELECT doc_id, regexp_matches(text, '{checks.PHONE}') OR regexp_matches(text, '(?i){checks.MAIL}') AS has_pii FROM documents")
def pii_flag(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", checks.has_pii(F.col("text")).alias("has_pii"))


@query("reviewed_only", "SELECT d.doc_id, d.source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE COALESCE(l.toxic = 1, FALSE) = FALSE AND d.source IS DISTINCT FROM 'src3'")
def reviewed_only(t: Tables) -> DataFrame:
    """Toxic rows stand for rows in need of review, src3 for drafts."""
    joined = t.documents.join(t.labels, "doc_id", "left")
    return joined.filter(~F.coalesce(F.col("toxic") == 1, F.lit(False)) & ~F.col("source").eqNullSafe("src3")).select("doc_id", "source")


@query(
    "quality_gate",
    """
WITH measured AS (SELECT doc_id, n_chars, n_chars / 1000.0 AS seconds, (doc_id % 100) / 5000.0 AS rms, text FROM documents)
SELECT doc_id, CASE WHEN n_chars < 200 THEN 'audio_too_small' WHEN seconds < 0.35 THEN 'too_short' WHEN rms < 0.008 THEN 'too_quiet' ELSE 'ok' END AS verdict,
       CAST(least(seconds, 45.0) AS DOUBLE) AS seconds_used FROM measured
""",
)
def quality_gate(t: Tables) -> DataFrame:
    """Characters stand for bytes and, by thousands, for seconds; the loudness is made from the key."""
    seconds = F.col("n_chars") / 1000.0
    return t.documents.select("doc_id", checks.audio_verdict(F.col("n_chars"), seconds, (F.col("doc_id") % 100) / 5000.0).alias("verdict"), F.least(seconds, F.lit(45.0)).alias("seconds_used"))


@query(
    "repetition_flag",
    """
WITH lower_case AS (SELECT doc_id, regexp_replace(lower(text), '^[\\t-\\r\\x{85}\\p{Z}]+|[\\t-\\r\\x{85}\\p{Z}]+$', '', 'g') AS t FROM documents),
words AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\\t-\\r\\x{85}\\p{Z}]+'), lambda x: x <> '') AS w FROM lower_case)
SELECT doc_id, t = '' OR """
    + " OR ".join(f"contains(t, '{m}')" for m in checks.MARKERS)
    + """ OR (len(w) >= 6 AND (length(t) - length(replace(t, w[1] || ' ' || w[2] || ' ' || w[3], ''))) / length(w[1] || ' ' || w[2] || ' ' || w[3]) >= 3) AS repeats FROM words
""",
)
def repetition_flag(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", checks.repeats(F.col("text")).alias("repeats"))


@query(
    "weak_signal",
    "SELECT event_id, COALESCE(value / 100 < 1.4, FALSE) OR COALESCE(value / 10000 > 0 AND value / 10000 < 0.015, FALSE) OR COALESCE((event_id % 100) / 100.0 < 0.55, FALSE) AS weak FROM events",
)
def weak_signal(t: Tables) -> DataFrame:
    return t.events.select("event_id", checks.weak_signal(F.col("value") / 100, F.col("value") / 10000, (F.col("event_id") % 100) / 100.0, F.lit("a steady sentence")).alias("weak"))


@query(
    "drop_failure_replies",
    r"""
WITH said AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 AND role = 'assistant' THEN 'Sorry,  the Service is temporarily unavailable.' ELSE text END AS content FROM conversations)
SELECT conv_id, turn, role FROM said WHERE role = 'user' OR NOT contains(trim(regexp_replace(lower(content), '\s+', ' ', 'g')), 'service is temporarily unavailable')
""",
)
def drop_failure_replies(t: Tables) -> DataFrame:
    """Every third turn of an assistant is a failure."""
    failed = (F.col("turn") % 3 == 0) & (F.col("role") == "assistant")
    said = t.conversations.withColumn("content", F.when(failed, "Sorry,  the Service is temporarily unavailable.").otherwise(F.col("text")))
    return said.filter((F.col("role") == "user") | ~checks.is_failure(F.col("content"))).select("conv_id", "turn", "role")


@query("upload_gate", "SELECT doc_id, (source LIKE '%1%' AND n_chars > 0 AND n_chars * 1024 <= 10 * 1024 * 1024) AS accepted FROM documents")
def upload_gate(t: Tables) -> DataFrame:
    """Sources with a 1 stand for audio types, characters for kilobytes."""
    return t.documents.select("doc_id", ((F.col("source").contains("1")) & (F.col("n_chars") * 1024).between(1, 10 * 1024 * 1024)).alias("accepted"))


@query("valid_ranges", "SELECT l_orderkey, l_linenumber, (l_quantity BETWEEN 1 AND 30 AND l_discount BETWEEN 0 AND 0.08 AND length(l_returnflag) <= 4000) AS valid FROM lineitem")
def valid_ranges(t: Tables) -> DataFrame:
    ok = F.col("l_quantity").between(1, 30) & F.col("l_discount").between(0, 0.08) & (F.length("l_returnflag") <= 4000)
    return t.lineitem.select("l_orderkey", "l_linenumber", ok.alias("valid"))


@query("unexpired_latest", f"SELECT user_id, max(event_id) AS event_id FROM events WHERE ts > TIMESTAMP '{CLOCK}' AND event_type = 'signup' GROUP BY user_id")
def unexpired_latest(t: Tables) -> DataFrame:
    """The last sign-up of each user that lies after the clock, by number."""
    live = t.events.filter(F.col("ts") > F.lit(CLOCK).cast("timestamp_ntz")).filter("event_type = 'signup'")
    return live.groupBy("user_id").agg(F.max("event_id").alias("event_id"))


CATALOG = ["promo", "red", "ring"]


@query(
    "catalog_search",
    "SELECT p_partkey, p_name, p_retailprice FROM part WHERE "
    + " OR ".join(f"contains(lower({c}), '{w}')" for w in CATALOG for c in ("p_name", "p_brand", "p_type"))
    + " ORDER BY p_retailprice DESC, p_name, p_partkey LIMIT 5",
)
def catalog_search(t: Tables) -> DataFrame:
    """The five dearest parts that have a token of the request in a name, brand or type."""
    from loomwork.functions.text import query_tokens

    tokens = query_tokens("a Red promo ring for me")
    hit = reduce(or_, (checks.icontains(F.col(c), w) for w in tokens for c in ("p_name", "p_brand", "p_type")))
    return t.part.filter(hit).orderBy(F.desc("p_retailprice"), "p_name", "p_partkey").limit(5).select("p_partkey", "p_name", "p_retailprice")
