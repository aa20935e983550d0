"""Grouped and global aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.core import Tables, query
from loomwork.functions.text import corpus_words
from loomwork.plans.joins import RESULTS_SQL, results

BUCKETS = ["click", "error", "purchase", "refund", "signup", "view"]


@query(
    "bucket_counts_zero_filled",
    "SELECT b.bucket, CAST(count(e.event_id) AS BIGINT) AS n FROM (VALUES " + ", ".join(f"('{b}')" for b in BUCKETS) + ") b(bucket) LEFT JOIN events e ON e.event_type = b.bucket GROUP BY b.bucket",
)
def bucket_counts_zero_filled(t: Tables) -> DataFrame:
    """A fixed list of buckets, one of which never occurs."""
    counts = t.events.groupBy(F.col("event_type").alias("bucket")).agg(F.count("*").alias("n"))
    wanted = t.spark.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    return wanted.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


_STATS = """CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE d.doc_id % 10 = 0) AS BIGINT) AS n_holdout, CAST(count(DISTINCT d.source) AS BIGINT) AS n_speakers,
 CAST(count(*) FILTER (WHERE l.toxic = 1) AS BIGINT) AS n_synthetic, CAST(count(*) FILTER (WHERE l.doc_id IS NULL) AS BIGINT) AS n_missing, round(CAST(sum(d.n_chars / 1000.0) AS DOUBLE), 6) AS seconds"""


def _stats(df: DataFrame, *by: str, rollup: bool = False) -> DataFrame:
    grouped = df.rollup(*by) if rollup else df.groupBy(*by)
    return grouped.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("doc_id") % 10 == 0).alias("n_holdout"),
        F.countDistinct("source").alias("n_speakers"),
        F.count_if(F.col("toxic") == 1).alias("n_synthetic"),
        F.count_if(F.col("labelled").isNull()).alias("n_missing"),
        F.round(F.sum(F.col("n_chars")) / 1000.0, 6).alias("seconds"),
    )


def _documents(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels.withColumn("labelled", F.lit(True)), "doc_id", "left")


@query("bucket_stats", f"SELECT d.lang AS bucket, {_STATS} FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang")
def bucket_stats(t: Tables) -> DataFrame:
    """Languages as buckets, sources as speakers, every tenth document held out, toxic ones as synthetic."""
    return _stats(_documents(t), "lang").withColumnRenamed("lang", "bucket")


@query("bucket_stats_rollup", f"SELECT COALESCE(d.lang, 'TOTAL') AS bucket, {_STATS} FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ROLLUP (d.lang)")
def bucket_stats_rollup(t: Tables) -> DataFrame:
    return _stats(_documents(t), "lang", rollup=True).withColumn("lang", F.coalesce("lang", F.lit("TOTAL"))).withColumnRenamed("lang", "bucket")


@query("distinct_with_default", "SELECT lang, CAST(count(DISTINCT COALESCE(CASE WHEN doc_id % 7 <> 0 THEN source END, CASE WHEN doc_id % 14 <> 0 THEN 'alias' END, 'unknown')) AS BIGINT) AS n_speakers FROM documents GROUP BY lang")
def distinct_with_default(t: Tables) -> DataFrame:
    """Some sources lack a label and some of those an alias too: all unknown ones are one speaker."""
    who = F.coalesce(F.when(F.col("doc_id") % 7 != 0, F.col("source")), F.when(F.col("doc_id") % 14 != 0, "alias"), F.lit("unknown"))
    return t.documents.groupBy("lang").agg(F.countDistinct(who).alias("n_speakers"))


@query("order_total", "SELECT l_orderkey, round(sum(l_extendedprice * l_quantity), 4) AS total FROM lineitem GROUP BY l_orderkey")
def order_total(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_quantity")), 4).alias("total"))


@query(
    "conditional_counts",
    "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS n_pending, CAST(count(*) FILTER (WHERE o_totalprice > 1000) AS BIGINT) AS n_large FROM orders",
)
def conditional_counts(t: Tables) -> DataFrame:
    return t.orders.agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("n_pending"), F.count_if(F.col("o_totalprice") > 1000).alias("n_large"))


@query("all_gates_pass", "SELECT o_orderpriority, bool_and(o_totalprice > 0) AS all_priced, bool_or(o_orderstatus = 'P') AS any_pending FROM orders GROUP BY o_orderpriority")
def all_gates_pass(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.bool_and(F.col("o_totalprice") > 0).alias("all_priced"), F.bool_or(F.col("o_orderstatus") == "P").alias("any_pending"))


@query(
    "worst_level_status",
    """
WITH ranked AS (SELECT o_custkey, max(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN 2 WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS worst FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY o_custkey)
SELECT o_custkey, CASE worst WHEN 2 THEN 'blocked' WHEN 1 THEN 'degraded' ELSE 'ready' END AS status FROM ranked
""",
)
def worst_level_status(t: Tables) -> DataFrame:
    """Orders as checks: pending urgent ones fail, other pending ones degrade, and low ones aren't required."""
    level = F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P"), 2).when(F.col("o_orderstatus") == "P", 1).otherwise(0)
    worst = t.orders.filter("o_orderpriority <> '5-LOW'").groupBy("o_custkey").agg(F.max(level).alias("worst"))
    return worst.select("o_custkey", F.when(F.col("worst") == 2, "blocked").when(F.col("worst") == 1, "degraded").otherwise("ready").alias("status"))


@query("best_by_metric", RESULTS_SQL + " SELECT model, slice, arg_min(run, {'w': wer, 'r': run}) AS best_run, min(wer) AS best_wer FROM results WHERE wer IS NOT NULL GROUP BY model, slice")
def best_by_metric(t: Tables) -> DataFrame:
    """The run with the lowest rate; of equals the first."""
    return results(t).filter("wer is not null").groupBy("model", "slice").agg(F.min_by("run", F.struct("wer", "run")).alias("best_run"), F.min("wer").alias("best_wer"))


@query(
    "vocab_stats",
    r"""
WITH lines AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM documents),
kept AS (SELECT t, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS r FROM lines WHERE t <> ''),
words AS (SELECT UNNEST(string_split(t, ' ')) AS w FROM kept WHERE r = 1)
SELECT (SELECT CAST(count(*) AS BIGINT) FROM kept) AS n_lines, (SELECT CAST(count(*) AS BIGINT) FROM kept WHERE r > 1) AS n_removed, CAST(count(*) AS BIGINT) AS n_tokens, CAST(count(DISTINCT w) AS BIGINT) AS n_vocab FROM words
""",
)
def vocab_stats(t: Tables) -> DataFrame:
    """Lines, repeated lines, tokens and distinct tokens of the corpus, in one scan. Lines are told apart by a hash: a text gives a
    row of its hash with its number of tokens, and a row of each distinct token, so that no text is shuffled."""
    lines = t.spread(t.documents.select("text")).select(corpus_words(F.col("text")).alias("t")).select(F.sha2("t", 256).alias("line"), F.when(F.col("t") != "", F.split("t", " ")).alias("w"))
    row = lambda line, n, word: F.struct(line.alias("line"), n.alias("n"), word.alias("word"))
    none, no_line = F.lit(None).cast("int"), F.lit(None).cast("string")
    rows = F.concat(F.array(row(F.col("line"), F.size("w"), no_line)), F.transform(F.array_distinct("w"), lambda w: row(no_line, none, w)))
    each = lines.select(F.explode(rows).alias("r")).groupBy("r.line", "r.word").agg(F.count("*").alias("copies"), F.first("r.n").alias("n"))
    is_line = F.col("line").isNotNull()
    sums = [F.sum(F.when(is_line, F.col("copies"))), F.sum(F.when(is_line, F.col("copies") - 1)), F.sum("n"), F.count("word")]
    return each.agg(*(F.coalesce(s, F.lit(0)).cast("long").alias(name) for s, name in zip(sums, ("n_lines", "n_removed", "n_tokens", "n_vocab"), strict=True)))


@query(
    "trigram_counts",
    r"""
WITH lines AS (SELECT string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ') AS w FROM documents),
grams AS (SELECT UNNEST(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS gram FROM lines WHERE len(w) >= 3)
SELECT gram, CAST(count(*) AS BIGINT) AS n FROM grams GROUP BY gram
""",
)
def trigram_counts(t: Tables) -> DataFrame:
    """How often each word trigram occurs. Words are zipped with themselves, one and two places on."""
    words = t.spread(t.documents.select("text")).select(F.split(corpus_words(F.col("text")), " ").alias("w"))
    after = lambda n: F.slice("w", n + 1, F.greatest(F.size("w") - 2, F.lit(0)))
    grams = words.select(F.inline(F.arrays_zip(after(0), after(1), after(2))).alias("a", "b", "c")).select(F.concat_ws(" ", "a", "b", "c").alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


@query("rms_energy", "SELECT vec_id, round(sqrt(sum(x * x) / count(*)), 6) AS rms, round(max(abs(x)), 6) AS peak FROM (SELECT vec_id, CAST(UNNEST(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY vec_id")
def rms_energy(t: Tables) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    rms = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) / F.size(v))
    return t.embeddings.select("vec_id", F.round(rms, 6).alias("rms"), F.round(F.array_max(F.transform(v, F.abs)), 6).alias("peak"))


@query(
    "repeated_text_groups",
    """
WITH g AS (SELECT md5(text) AS text_md5, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1)
SELECT *, CAST(greatest((SELECT count(*) FROM g) - 15, 0) AS BIGINT) AS n_more FROM g ORDER BY n DESC, first_id LIMIT 15
""",
)
def repeated_text_groups(t: Tables) -> DataFrame:
    """The 15 largest groups of equal texts, and how many more there are."""
    groups = t.documents.groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")
    more = groups.agg(F.greatest(F.count("*") - 15, F.lit(0)).cast("long").alias("n_more"))
    return groups.orderBy(F.desc("n"), "first_id").limit(15).withColumn("n_more", more.scalar())


@query("label_counts", "SELECT lang, source, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY lang, source")
def label_counts(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang", "source").agg(F.count("*").alias("n"))


@query(
    "last_regex_match",
    """SELECT page_id, list_extract(regexp_extract_all(html, 'href="([^"]*)"', 1), -1) AS last_link, list_extract(regexp_extract_all(html, '<h[1-6][^>]*>([^<]*)<', 1), -1) AS last_heading FROM pages""",
)
def last_regex_match(t: Tables) -> DataFrame:
    """Of each pattern the last match in a page."""
    last = lambda p: F.try_element_at(F.regexp_extract_all("html", F.lit(p), F.lit(1)), F.lit(-1))
    return t.pages.select("page_id", last('href="([^"]*)"').alias("last_link"), last("<h[1-6][^>]*>([^<]*)<").alias("last_heading"))
