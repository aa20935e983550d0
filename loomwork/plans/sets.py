"""Unions, distinct values, expansion and weighted mixing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.core import Tables, query
from loomwork.operators.samples import interleaved
from loomwork.plans.joins import RESULTS_SQL, results

_UNION = "SELECT 'documents' AS origin, doc_id AS id, text FROM documents UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations UNION ALL SELECT 'benchmark', item_id, text FROM benchmark"


def _union(t: Tables) -> DataFrame:
    parts = [("documents", t.documents, F.col("doc_id")), ("conversations", t.conversations, F.col("conv_id") * 1000 + F.col("turn")), ("benchmark", t.benchmark, F.col("item_id"))]
    return reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("origin"), key.alias("id"), "text") for name, df, key in parts))


@query("union_sources", f"SELECT origin, id, length(text) AS n_chars FROM ({_UNION})")
def union_sources(t: Tables) -> DataFrame:
    return _union(t).select("origin", "id", F.length("text").cast("long").alias("n_chars"))


@query("union_dedup", f"SELECT origin, id FROM (SELECT origin, id, row_number() OVER (PARTITION BY text ORDER BY origin DESC, id) AS r FROM ({_UNION})) WHERE r = 1")
def union_dedup(t: Tables) -> DataFrame:
    """Of equal texts the one from the first source in order (documents, conversations, benchmark), with the least id."""
    first = _union(t).groupBy(F.sha2("text", 256)).agg(F.min(F.struct(F.when(F.col("origin") == "documents", 0).when(F.col("origin") == "conversations", 1).otherwise(2), "id", "origin")).alias("f"))
    return first.select("f.origin", "f.id")


@query("distinct_sorted", "SELECT DISTINCT p_brand FROM part ORDER BY p_brand")
def distinct_sorted(t: Tables) -> DataFrame:
    return t.part.select("p_brand").distinct().orderBy("p_brand")


@query("intersect_keys", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def intersect_keys(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").intersect(t.labels.select("doc_id"))


@query(
    "expand_variants",
    RESULTS_SQL
    + """ SELECT run, 'base' AS variant, wer, 1 AS beams FROM results UNION ALL SELECT run, 'full_test', round(wer + 1, 6), 1 FROM results WHERE slice = 'A' OR slice = 'R'
UNION ALL SELECT run, 'beam5', round(wer + 0.5, 6), 5 FROM results WHERE slice = 'R'""",
)
def expand_variants(t: Tables) -> DataFrame:
    """A result gives up to three rows; slice A stands for results with a full test, R for those with a beam search too."""
    row = lambda name, add, beams: F.struct(F.lit(name).alias("variant"), F.round(F.col("wer") + add, 6).alias("wer"), F.lit(beams).alias("beams"))
    rows = F.array(row("base", 0.0, 1), F.when(F.col("slice").isin("A", "R"), row("full_test", 1.0, 1)), F.when(F.col("slice") == "R", row("beam5", 0.5, 5)))
    return results(t).select("run", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("run", "r.variant", "r.wer", "r.beams")


@query(
    "weighted_mix",
    """
WITH s AS (SELECT lang, count(*) AS n, CASE lang WHEN 'en' THEN 0.6 WHEN 'fr' THEN 0.25 WHEN 'de' THEN 0.2 ELSE 0.15 END AS w FROM documents GROUP BY lang),
r AS (SELECT lang, n, w / (SELECT sum(w) FROM s) AS share, max(n / w) OVER () * w AS want FROM s)
SELECT d.doc_id, d.lang, CAST(UNNEST(range(1, 1 + CAST(floor(want / n + 1e-9) AS BIGINT) + CASE WHEN ('0x' || substr(md5('mix:' || d.doc_id), 1, 8))::BIGINT / 4294967296.0 < want / n + 1e-9 - floor(want / n + 1e-9) THEN 1 ELSE 0 END)) AS INTEGER) AS copy
FROM documents d JOIN r ON d.lang IS NOT DISTINCT FROM r.lang
""",
)
def weighted_mix(t: Tables) -> DataFrame:
    """A null source is one of its own. Short sources repeat until the longest for its weight ends: whole times, and once more by a hash for the rest."""
    weight = F.when(F.col("lang") == "en", 0.6).when(F.col("lang") == "fr", 0.25).when(F.col("lang") == "de", 0.2).otherwise(0.15)
    sizes = t.documents.groupBy("lang").agg(F.count("*").alias("n")).withColumn("w", weight)
    longest = sizes.agg(F.max(F.col("n") / F.col("w"))).scalar()
    times = sizes.select("lang", (longest * F.col("w") / F.col("n") + 1e-9).alias("times"))
    chance = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("mix"), "doc_id")), 1, 8), 16, 10).cast("double") / 4294967296.0
    whole = F.floor("times").cast("int")
    copies = whole + (chance < F.col("times") - whole).cast("int")
    mixed = t.documents.select("doc_id", "lang").join(times.withColumnRenamed("lang", "own"), F.expr("lang <=> own")).withColumn("copies", copies).filter("copies > 0")
    return mixed.select("doc_id", "lang", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))


@query(
    "interleaved_mix",
    """
WITH own AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i FROM documents),
sizes AS (SELECT lang, coalesce(lang, '') AS name, count(*) AS n, CASE lang WHEN 'en' THEN 0.6::DOUBLE WHEN 'fr' THEN 0.25::DOUBLE WHEN 'de' THEN 0.2::DOUBLE ELSE 0.15::DOUBLE END AS w FROM documents GROUP BY lang),
shares AS (SELECT lang, name, n, w / (SELECT sum(w) FROM (SELECT w FROM sizes ORDER BY name)) AS w FROM sizes),
draws AS (SELECT lang, name, n, w, UNNEST(range(0, CAST(ceil((SELECT max(n / w) FROM shares) * w) AS BIGINT) + 2)) AS j FROM shares),
placed AS (SELECT *, (j + ('0x' || substr(md5('mix:' || name || ':' || j), 1, 8))::BIGINT / 4294967296::DOUBLE) / w AS due FROM draws),
ends AS (SELECT due AS end_due, name AS end_name FROM placed WHERE j = n - 1 ORDER BY due DESC, name DESC LIMIT 1),
taken AS (SELECT p.*, row_number() OVER (ORDER BY due, name) AS place FROM placed p, ends WHERE due < end_due OR due = end_due AND name <= end_name)
SELECT o.doc_id, t.lang, CAST(t.j // t.n AS INTEGER) AS copy, t.place FROM taken t JOIN own o ON o.lang IS NOT DISTINCT FROM t.lang AND o.i = t.j % t.n
""",
)
def interleaved_mix(t: Tables) -> DataFrame:
    """The documents in the order in which their languages are drawn by weight, until the longest for its weight ends."""
    weight = F.when(F.col("lang") == "en", 0.6).when(F.col("lang") == "fr", 0.25).when(F.col("lang") == "de", 0.2).otherwise(0.15)
    return interleaved(t.documents.select("doc_id", "lang"), "lang", weight, "doc_id", cut=t.cut)


@query("normalized_weights", "SELECT n_nationkey, round(greatest(0.01, n_regionkey * 0.1) / (SELECT sum(greatest(0.01, n_regionkey * 0.1)) FROM nation), 6) AS weight FROM nation")
def normalized_weights(t: Tables) -> DataFrame:
    w = F.greatest(F.lit(0.01), F.col("n_regionkey") * 0.1)
    return t.nation.select("n_nationkey", F.round(w / t.nation.agg(F.sum(w)).scalar(), 6).alias("weight"))


@query("scaled_caps", "SELECT n_nationkey, CAST(greatest(64, least(1000, round_even(2000 * (n_nationkey / 100.0)::DOUBLE / greatest(0.60, 0.05)::DOUBLE, 0))) AS BIGINT) AS cap FROM nation")
def scaled_caps(t: Tables) -> DataFrame:
    """At least 64, at most a source's own 1000, in between the limit by weights; halves go to the even number."""
    scaled = F.bround(2000 * (F.col("n_nationkey") / 100) / max(0.60, 0.05), 0)
    return t.nation.select("n_nationkey", F.greatest(F.lit(64), F.least(F.lit(1000), scaled.cast("long"))).cast("long").alias("cap"))


@query("min_group_size", "SELECT source, CAST(count(*) AS BIGINT) AS n FROM documents WHERE lang = 'en' GROUP BY source HAVING count(*) >= 30")
def min_group_size(t: Tables) -> DataFrame:
    return t.documents.filter("lang = 'en'").groupBy("source").agg(F.count("*").alias("n")).filter("n >= 30")
