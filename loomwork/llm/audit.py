"""Filter interaction audit: what each filter removes at each step of each order, from counts over the lattice of filter subsets."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm import common

#: Filters are at most so many: an order of f filters has f steps, and there are f! orders.
MOST_FILTERS = 7
WHITE = r"[ \t\n\x0B\f\r]+"


@dataclass(frozen=True)
class Filter:
    """A letter, and the condition of a text on which a document fails: true, false or null (passes)."""

    letter: str
    fails: Column


def words(text: Column) -> Column:
    """Maximal runs of characters other than space, \\t, \\n, \\v, \\f, \\r."""
    inner = F.regexp_replace(text, rf"\A{WHITE}|{WHITE}\z", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WHITE))


def marks(df: DataFrame, filters: list[Filter], duplicate: str | None, text: str, key: str, part: str) -> DataFrame:
    """part, id, mask (bit i: filter i fails) for each row of df, without its text.

    `duplicate` is the letter of the filter that fails documents whose text occurs under a smaller key, table-wide; texts are told
    apart by SHA-256, so none is shuffled. Its bit is the one after those of `filters`."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    bits = [F.when(F.coalesce(f.fails, F.lit(False)), F.lit(1 << i)).otherwise(0) for i, f in enumerate(filters)]
    mask = sum(bits[1:], bits[0]).cast("int") if bits else F.lit(0)
    rows = df.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(key).alias("id"), body.alias("text"))
    own = rows.select("part", "id", mask.alias("mask"), *([F.sha2(F.col("text").cast("binary"), 256).alias("digest")] if duplicate else []))
    if not duplicate:
        return own
    own = common.table(own, "marks")  # texts are read and judged once
    sizes = own.groupBy("digest").agg(F.count(F.lit(1)).alias("times"), F.min("id").alias("first"))
    seen = common.join_counted(own, sizes.filter("times > 1"), ["digest"], "times", own.count())
    again = F.when(F.col("id") > F.col("first"), F.lit(1 << len(filters))).otherwise(0)
    return seen.select("part", "id", (F.col("mask") + again).cast("int").alias("mask"))


def audit(df: DataFrame, labels: DataFrame, filters: list[Filter], duplicate: str | None = None, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each part, each
    order of the filters (with `duplicate` as the last letter, see marks()) and each step, zeros included.

    Per part, in documents: kept after the step, removed by it, redundant (failing its filter, removed earlier), unique_fails (failing
    its filter only), good_lost (removed here, label quality = 1), toxic_lost (removed here, toxic = 1) and shapley (the filter's
    removals, summed over all orders, at any step). For f filters, what a step removes depends on the set of those before it alone, so
    documents are counted for the f x 2^(f-1) edges from a set to the set with one filter more (80 for five); the f! orders (120) are
    paths over these edges, and their steps (600) are joined with them.

    A null part is the empty string, and one with it. A null text is empty. A null key isn't above or below any other, and has no
    label. Repeated rows count each for itself, and aren't duplicates of one another (their key isn't smaller). A key with several
    rows in `labels` is good, or toxic, if one of them says so. An empty table has no parts, so no rows. Other columns are ignored.

    Texts are read once. Rows of a hundred bytes are dealt by digest and by key, in both cases with hot values apart; then they are
    counted by part and mask, before anything is multiplied by edges or orders.
    """
    common.need(df, text, key, part)
    common.need(labels, key, "quality", "toxic")
    letters = "".join(f.letter for f in filters) + (duplicate or "")
    n = len(letters)
    if not 0 < n <= MOST_FILTERS or len(set(letters)) < n:
        raise ValueError(f"1 to {MOST_FILTERS} filters with different letters are needed")
    spark = df.sparkSession
    marked = common.table(marks(df, filters, duplicate, text, key, part), "masks")
    labelled = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    times = marked.groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    known = labelled.join(times, "id")
    with_labels = common.join_counted(marked, known, ["id"], "times", marked.count())
    masks = with_labels.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))

    edges = [(s, i, factorial(bin(s).count("1")) * factorial(n - 1 - bin(s).count("1"))) for s in range(1 << n) for i in range(n) if not s >> i & 1]
    edge = F.explode(F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(i).alias("next"), F.lit(w).cast("long").alias("orders")) for s, i, w in edges)))
    reach = masks.withColumn("edge", edge).select("part", "mask", "docs", "good", "toxic", "edge.*")
    bit = F.expr("shiftleft(1, next)")
    before, fails = F.col("mask").bitwiseAND(F.col("applied")) != 0, F.col("mask").bitwiseAND(bit) != 0
    counted = lambda when, what="docs": F.sum(F.when(when, F.col(what)).otherwise(0))
    by_edge = reach.groupBy("part", "applied", "next").agg(
        F.first("orders").alias("orders"),
        counted(~before & ~fails).alias("kept"),
        counted(~before & fails).alias("removed"),
        counted(before & fails).alias("redundant"),
        counted(F.col("mask") == bit).alias("unique_fails"),
        counted(~before & fails, "good").alias("good_lost"),
        counted(~before & fails, "toxic").alias("toxic_lost"),
    )
    by_edge = by_edge.withColumn("shapley", F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "next")))

    orders = [["".join(letters[i] for i in o), k + 1, letters[o[k]], sum(1 << i for i in o[:k]), o[k]] for o in permutations(range(n)) for k in range(n)]
    steps = spark.createDataFrame(orders, "filter_order string, step int, filter string, applied int, next int")
    paths = by_edge.join(F.broadcast(steps), ["applied", "next"])  # f x f! rows whatever the input
    return paths.select("part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def production_filters() -> list[Filter]:
    """A: under 200 words; B: distinct words under half of all; C: over 2 % of upper-case A to Z; D: a character of #$%&*|."""
    text, word = F.col("text"), words(F.col("text"))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [
        Filter("A", F.size(word) < 200),
        Filter("B", 100 * F.size(F.array_distinct(word)) < 50 * F.size(word)),
        Filter("C", 100 * capitals > 2 * F.length(text)),
        Filter("D", text.rlike(r"[#$%&*|]")),
    ]


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return audit(common.documents(spark, sf_dir), labels, production_filters(), "E").drop("filter")


ORACLES = {
    "op12_filter_audit": r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS words FROM documents
), judged AS (
  SELECT t.doc_id, t.part,
         [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(t.t, '[^A-Z]', '', 'g')) > 2 * length(t.t),
          regexp_matches(t.t, '[#$%&*|]'), t.doc_id > min(t.doc_id) OVER (PARTITION BY t.t)] AS fails,
         coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
  FROM texts t LEFT JOIN labels l ON t.doc_id = l.doc_id
), letters AS (SELECT UNNEST(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), patterns AS (
  SELECT part, fails, count(*) AS docs, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM judged GROUP BY part, fails
), met AS (
  SELECT p.*, o.filter_order, s.step, fails[ascii(filter_order[s.step]) - 64] AS here,
         len(list_filter(range(1, s.step), lambda k: fails[ascii(filter_order[k]) - 64])) > 0 AS before,
         len(list_filter(fails, lambda x: x)) = 1 AS single
  FROM patterns p, orders o, (SELECT UNNEST(range(1, 6)) AS step) s
), counted AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(sum(CASE WHEN NOT before AND NOT here THEN docs ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN NOT before AND here THEN docs ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN before AND here THEN docs ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN here AND single THEN docs ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN NOT before AND here THEN good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN NOT before AND here THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM met GROUP BY part, filter_order, step
)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley FROM counted
"""
}
QUERIES = {"op12_filter_audit": op12_filter_audit}
