"""Sorts, limits, top-k and samples. Every order ends in a unique key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.core import Tables, query
from loomwork.functions import vectors
from loomwork.operators.retrieval import confident, lexical_ranked, lexical_top_k
from loomwork.operators.samples import exact_sample
from loomwork.plans.joins import RESULTS_SQL, results

#: Anchors that are gathered into one row, and up to how many such rows are broadcast.
ANCHORS, BROADCAST_BLOCKS = 1000, 100


@query("sorted_scan", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey")
def sorted_scan(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_name").orderBy("p_name", "p_partkey")


@query("top_memories", "SELECT event_id, value FROM events WHERE user_id = 7 ORDER BY value DESC, ts DESC, event_id LIMIT 12")
def top_memories(t: Tables) -> DataFrame:
    return t.events.filter("user_id = 7").orderBy(F.desc("value"), F.desc("ts"), "event_id").limit(12).select("event_id", "value")


@query("audit_tail", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def audit_tail(t: Tables) -> DataFrame:
    """500 are asked for; no more than 200 are given."""
    asked = 500
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(min(asked or 50, 200)).select("event_id", "event_type")


_COSINE = """
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT v FROM q)), 6) AS score FROM embeddings WHERE vec_id <> 0)"""


def _scored(t: Tables) -> DataFrame:
    """Similarity of every vector to that of key 0, which travels as one row."""
    asked = t.embeddings.filter("vec_id = 0").select(vectors.doubles(F.col("embedding")).alias("asked"))
    rows = t.embeddings.filter("vec_id <> 0").join(F.broadcast(asked), F.lit(True))
    return rows.select("vec_id", F.round(vectors.cosine(vectors.doubles(F.col("embedding")), F.col("asked")), 6).alias("score"))


@query("vector_topk", _COSINE + " SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk(t: Tables) -> DataFrame:
    return _scored(t).orderBy(F.desc("score"), "vec_id").limit(10)


@query("vector_topk_confident", _COSINE + " SELECT vec_id, score FROM s WHERE score >= greatest(0.32, (SELECT max(score) FROM s) - 0.055) ORDER BY score DESC, vec_id LIMIT 5")
def vector_topk_confident(t: Tables) -> DataFrame:
    return confident(_scored(t), "score", "vec_id", limit=5, floor=0.32)


@query(
    "lexical_topk",
    """
WITH q AS (SELECT list_filter(string_split_regex(lower('The clinic and fever medicine, that is thetion!'), '[ ,.;!?]+'), lambda x: length(x) > 2) AS w),
s AS (SELECT doc_id, CAST(len(list_filter((SELECT w FROM q), lambda x: contains(lower(d.text), x))) AS DOUBLE) / (SELECT len(w) FROM q) AS score FROM documents d)
SELECT doc_id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10
""",
)
def lexical_topk(t: Tables) -> DataFrame:
    ranked = lexical_ranked(t.spread(t.documents.select("doc_id", "text")), "text", "The clinic and fever medicine, that is thetion!")
    return ranked.orderBy(F.desc("score"), "doc_id").limit(10).select("doc_id", F.round("score", 6).alias("score"))


@query(
    "lexical_topk_requests",
    r"""
WITH q AS (SELECT item_id, list_filter(string_split_regex(lower(nfc_normalize(text)), '[\s,.;!?]+'), lambda x: length(x) > 2) AS w FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(len(list_filter(w, lambda x: contains(t, x))) AS DOUBLE) / len(w) AS score FROM q, (SELECT doc_id, lower(nfc_normalize(text)) AS t FROM documents)),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10
""",
)
def lexical_topk_requests(t: Tables) -> DataFrame:
    """Every benchmark text as a request against all documents."""
    found = lexical_top_k(t.spread(t.documents.select("doc_id", "text")), t.benchmark, 10, t.cut, request_key="item_id")
    return found.select("item_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@query("leaderboard", RESULTS_SQL + " SELECT run, CASE WHEN slice <> 'N' THEN wer END AS wer FROM results WHERE n >= 49 ORDER BY wer NULLS LAST, run")
def leaderboard(t: Tables) -> DataFrame:
    """Runs with large samples; slice N stands for runs without a rate, which come last."""
    return results(t).filter("n >= 49").select("run", F.when(F.col("slice") != "N", F.col("wer")).alias("wer")).orderBy(F.asc_nulls_last("wer"), "run")


@query("hash_holdout_split", "SELECT doc_id, ('0x' || substr(md5('split:' || doc_id), 1, 8))::BIGINT % 100 < 5 AS held_out FROM documents")
def hash_holdout_split(t: Tables) -> DataFrame:
    """Five of a hundred documents, by a hash that every run and language computes alike."""
    return t.documents.select("doc_id", (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("split"), "doc_id")), 1, 8), 16, 10).cast("long") % 100 < 5).alias("held_out"))


SAMPLED = 150
CAPS = {"en": 100, "fr": 40, "de": 30}


@query("exact_sample", f"SELECT doc_id FROM documents ORDER BY ('0x' || substr(md5('sample:' || doc_id), 1, 15))::BIGINT, doc_id LIMIT {SAMPLED}")
def exact_sample_query(t: Tables) -> DataFrame:
    """So many documents, which is the feature: those with the smallest hashes, found without a sort."""
    return exact_sample(t.documents.select("doc_id"), SAMPLED, "doc_id", cut=t.cut)


@query(
    "exact_sample_by_split",
    "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY ('0x' || substr(md5('split:' || doc_id), 1, 15))::BIGINT, doc_id) AS r FROM documents) WHERE r <= CASE lang "
    + " ".join(f"WHEN '{k}' THEN {v}" for k, v in CAPS.items()) + " ELSE 20 END",
)
def exact_sample_by_split(t: Tables) -> DataFrame:
    """Each language up to its own cap, which is the feature."""
    cap = F.coalesce(F.create_map(*(F.lit(x) for p in CAPS.items() for x in p))[F.col("lang")], F.lit(20))
    return exact_sample(t.documents.select("doc_id", "lang"), cap, "doc_id", by="lang", seed="split", cut=t.cut)


@query("seeded_order", "SELECT doc_id, ('0x' || substr(md5('order:' || doc_id), 1, 12))::BIGINT AS place FROM documents ORDER BY place, doc_id")
def seeded_order(t: Tables) -> DataFrame:
    """All documents in an order that a seed and the key decide."""
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("order"), "doc_id")), 1, 12), 16, 10).cast("long")
    return t.documents.select("doc_id", place.alias("place")).orderBy("place", "doc_id")


@query(
    "retrieval_at_1",
    """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
a AS (SELECT label, min(vec_id) AS anchor FROM v GROUP BY label),
s AS (SELECT v.vec_id, v.label, a.label AS near, round(list_cosine_similarity(v.v, w.v), 9) AS score FROM v, a JOIN v w ON a.anchor = w.vec_id),
r AS (SELECT label, near, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, near) AS k FROM s)
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN label = near THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM r WHERE k = 1
""",
)
def retrieval_at_1(t: Tables) -> DataFrame:
    """Share of vectors whose nearest anchor is their own group's. Anchors, one a label, are gathered in rows of ANCHORS; each vector
    meets every such row, and with several the best of them counts."""
    rows = t.embeddings.select("vec_id", "label", vectors.doubles(F.col("embedding")).alias("v"))
    anchors = rows.groupBy("label").agg(F.min_by("v", "vec_id").alias("v"))
    blocks = -(-anchors.count() // ANCHORS)
    gathered = anchors.groupBy(F.pmod(F.xxhash64("label"), F.lit(max(1, blocks))).alias("block")).agg(F.collect_list(F.struct("label", "v")).alias("anchors"))
    met = rows.join(F.broadcast(gathered) if blocks <= BROADCAST_BLOCKS else gathered, F.lit(True))
    scores = F.transform("anchors", lambda a: F.struct(F.round(vectors.cosine(F.col("v"), a["v"]), 9).alias("score"), (-a["label"]).alias("order")))
    near = met.select("vec_id", "label", F.array_max(scores).alias("best"))
    if blocks > 1:
        near = near.groupBy("vec_id", "label").agg(F.max("best").alias("best"))
    return near.agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == -F.col("best.order")).cast("double")), 6).alias("hit_rate"))
