"""Mixing sources to target weights by Poisson replication: each document is repeated a hash-seeded Poisson number of times."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import common

#: Weights of sources are their numbers of documents to this power: below 1, small sources gain.
TEMPERATURE = 0.7
SEED = "mix"
BROADCAST_SOURCES = 1_000_000
#: A rate is split into equal parts of at most this mean, each drawn for itself: their sum is Poisson again, and no part underflows.
PART_RATE = 8.0
#: With 48-bit uniform numbers no part of that mean comes out higher.
MOST = 60
HEX = 12


def rates(sizes: DataFrame, weights: dict[str, float] | None, temperature: float, total: float | None) -> DataFrame:
    """source, n, rate: the mean repetition that brings a source of n documents to its share of `total` documents.

    weights: by source, in any unit; sources without a weight get none. Without weights they are n ** temperature."""
    if weights is None:
        sized = sizes.withColumn("weight", F.pow("n", F.lit(float(temperature))))
    else:
        cases = F.lit(0.0)
        for name, w in weights.items():
            cases = F.when(F.col("source") == name, F.lit(float(w))).otherwise(cases)
        sized = sizes.withColumn("weight", cases)
    sums = sized.agg(F.sum("weight").alias("weights"), F.sum("n").alias("rows")).first()
    target, weight = float(total if total is not None else sums["rows"] or 0), float(sums["weights"] or 0) or 1.0
    return sized.select("source", "n", (F.col("weight") / weight * target / F.col("n")).alias("rate"))


def uniform(*parts: Column) -> Column:
    """From 0 to 1, by the first 48 bits of the MD5 of the parts joined by colons."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, HEX)
    return F.conv(digits, 16, 10).cast("double") / float(16**HEX)


def inverse_poisson(u: Column, mean: Column) -> Column:
    """The smallest k whose cumulative probability exceeds u: by walking the terms e^-m m^k / k!."""
    steps = F.aggregate(
        F.sequence(F.lit(0), F.lit(MOST)),
        F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("term"), F.exp(-mean).alias("cdf")),
        lambda s, i: F.struct(
            (s["k"] + F.when(u >= s["cdf"], 1).otherwise(0)).alias("k"),
            (s["term"] * mean / (i + 1)).alias("term"),
            (s["cdf"] + s["term"] * mean / (i + 1)).alias("cdf"),
        ),
        lambda s: s["k"],
    )
    return steps


def copies(key: Column, rate: Column, seed: str) -> Column:
    """A Poisson number with mean `rate`, decided by seed and key alone."""
    parts = F.greatest(F.ceil(rate / PART_RATE).cast("int"), F.lit(1))
    mean = rate / parts
    draws = F.transform(F.sequence(F.lit(1), parts), lambda i: inverse_poisson(uniform(F.lit(seed), key, i), mean))
    return F.when(rate > 0, F.aggregate(draws, F.lit(0), lambda a, x: a + x)).otherwise(0)


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, total: float | None = None, seed: str = SEED) -> DataFrame:
    """Every row as often as its Poisson number says, in an order that a hash decides, with the columns of df and __copy (from 1), __copies, __rate and __order
    (columns of df with these names, or named __source, __n or __hot, are dropped).

    `total` is the expected number of rows returned (as many as df has, unless given). A null source is a source of its own, without
    a weight if weights are given. Repeated rows with one key get the same number; null keys share one. Null texts and empty tables
    pass as they are. The counts of each source are pre-aggregated; the table of sources is joined by broadcast only as long as it
    stays below BROADCAST_SOURCES rows, beyond that only its largest sources are. Rows are dealt to partitions by a hash of key and
    copy and sorted by it there: a global shuffle, in which a large source is spread like any other.
    """
    common.need(df, key, source)
    df = df.drop("__source", "__n", "__hot", "__copy", "__copies", "__rate", "__order")
    sizes = df.groupBy(F.col(source).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    table = common.table(rates(sizes, weights, temperature, total), "rates")
    names = list(df.columns)
    named = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null")).alias("__source")
    rated = table.select(named(F.col("source")), F.col("n").alias("__n"), F.col("rate").alias("__rate"))
    facts = table.agg(F.count(F.lit(1)).alias("sources"), F.sum("n").alias("rows")).first()
    marked = df.withColumn("__source", named(F.col(source)))
    if facts["sources"] < BROADCAST_SOURCES:
        rated = marked.join(F.broadcast(rated), "__source")
    else:
        rated = common.join_counted(marked, rated, ["__source"], "__n", facts["rows"], "inner")
    text_key = F.col(key).cast("string")
    counted = rated.drop("__source", "__n").withColumn("__copies", copies(text_key, F.col("__rate"), seed)).filter("__copies > 0")
    every = counted.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    order = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), text_key, F.col("__copy"))), 1, HEX), 16, 10).cast("long")
    mixed = every.withColumn("__order", order).repartition("__order").sortWithinPartitions("__order", key, "__copy")
    return mixed.select(*names, "__copy", "__copies", "__rate", "__order")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(common.documents(spark, sf_dir))
    return mixed.select("doc_id", "source", F.col("__copy").alias("copy"), F.col("__copies").alias("copies"), F.round("__rate", 9).alias("rate"), F.col("__order").alias("shuffle_order"), F.octet_length("text").cast("long").alias("n_bytes"))


def _factorials() -> str:
    """The cumulative probabilities of every mean, as SQL: one row for each k."""
    return ", ".join(f"({k}, {math.factorial(k)}::DOUBLE)" for k in range(MOST + 1))


ORACLES = {
    "op4_mixing": f"""
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
weighted AS (SELECT source, n, pow(n::DOUBLE, {TEMPERATURE}::DOUBLE) AS w FROM sizes),
rates AS (
  SELECT source, w / (SELECT sum(w) FROM weighted) * (SELECT sum(n) FROM sizes) / n AS rate,
         greatest(CAST(ceil(w / (SELECT sum(w) FROM weighted) * (SELECT sum(n) FROM sizes) / n / {PART_RATE}) AS BIGINT), 1) AS parts
  FROM weighted
),
terms(k, factorial) AS (VALUES {_factorials()}),
steps AS (
  SELECT source, k, sum(exp(-rate / parts) * pow(rate / parts, k) / factorial) OVER (PARTITION BY source ORDER BY k) AS cdf FROM rates, terms
),
draws AS (
  SELECT d.doc_id, d.source, ('0x' || substr(md5('{SEED}:' || d.doc_id || ':' || p.i), 1, {HEX}))::BIGINT / {16**HEX}::DOUBLE AS u
  FROM documents d JOIN rates r ON d.source = r.source, (SELECT UNNEST(range(1, 1000)) AS i) p WHERE p.i <= r.parts
),
counted AS (
  SELECT d.doc_id, count(*) AS copies FROM draws d JOIN steps s ON d.source = s.source AND d.u >= s.cdf GROUP BY d.doc_id
),
every AS (
  SELECT c.doc_id, c.copies, UNNEST(range(1, c.copies + 1)) AS copy FROM counted c
)
SELECT e.doc_id, d.source, CAST(e.copy AS INTEGER) AS copy, CAST(e.copies AS INTEGER) AS copies, round(r.rate, 9) AS rate,
       ('0x' || substr(md5('{SEED}:order:' || e.doc_id || ':' || e.copy), 1, {HEX}))::BIGINT AS shuffle_order,
       CAST(strlen(d.text) AS BIGINT) AS n_bytes
FROM every e JOIN documents d ON e.doc_id = d.doc_id JOIN rates r ON d.source = r.source
"""
}
QUERIES = {"op4_mixing": op4_mixing}
