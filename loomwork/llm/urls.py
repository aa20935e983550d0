"""URL filters: host and path rules, and exact membership in a block list by a cascade of Bloom filters. Built-in functions only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import common

#: The production rules, as verdict and rule (host, then path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A level lets through as many keys that it doesn't hold as makes a tenth of those that it holds, and never more than MOST_FALSE of the rest.
NEXT_LEVEL = 0.1
MOST_FALSE = 0.015
MOST_HASHES = 24
#: The keys are dealt by hash to as many cascades as keep the first filter of each within this size.
MAX_FILTER_BYTES = 8 << 20


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the url is null or has no `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. Of equally long rules the first listed wins."""
    rule = verdict = None
    for says, text in sorted(rules, key=lambda r: -len(r[1])):
        own_host, _, rest = text.partition("/")
        fits = ((host == own_host) | F.endswith(host, F.lit("." + own_host))) & F.startswith(path, F.lit("/" + rest))
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(says)) if verdict is None else verdict.when(fits, F.lit(says))
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits).cast("long")) for i in range(hashes)]


def shape(held: int, others: int) -> tuple[int, int]:
    """Bits (in whole words) and hashes of a filter of `held` keys, with `others` keys to be told from them."""
    false = min(MOST_FALSE, NEXT_LEVEL * max(held, 1) / max(others, 1))
    hashes = min(MOST_HASHES, max(1, math.ceil(-math.log2(false))))
    return max(1, math.ceil(held * hashes / math.log(2) / 64)) * 64, hashes


def _word_and_mask(position: Column) -> tuple[Column, Column]:
    return (F.floor(position / 64)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(position, F.lit(64)).cast("int"))


def filter_words(keys: DataFrame, level: int, bits: int, hashes: int) -> DataFrame:
    """One row with the Bloom filter of `key` as an array of 64-bit words: `bits` bounds its size."""
    positions = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits, hashes))).alias("p"))
    word, mask = _word_and_mask(F.col("p"))
    spark = keys.sparkSession
    blank = spark.range(bits // 64).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("m"))
    words = positions.select(word.alias("w"), mask.alias("m")).unionByName(blank).groupBy("w").agg(F.bit_or("m").alias("m"))
    return words.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "m"))), lambda s: s["m"]).alias("words"))


def contains(words: Column, key: Column, level: int, bits: int, hashes: int) -> Column:
    tests = []
    for p in _positions(key, level, bits, hashes):
        word, mask = _word_and_mask(p)
        tests.append(F.get(words, word).bitwiseAND(mask) != 0)
    return reduce(lambda a, b: a & b, tests)


class Cascade:
    """Bloom filters whose even levels encode listed keys and whose odd levels the false positives of the level before, over the
    whole key universe, until a level has none. Within the universe membership is exact."""

    def __init__(self, keys: DataFrame):
        """keys: (key, listed), every key of the universe once."""
        self.levels: list[tuple[DataFrame, int, int]] = []
        rest = keys.select("key", F.col("listed").alias("encode"))
        while True:
            sizes = rest.agg(F.count_if("encode").alias("held"), F.count_if(~F.col("encode")).alias("others")).first()
            if not sizes["held"]:
                return
            level, (bits, hashes) = len(self.levels), shape(sizes["held"], sizes["others"])
            words = common.table(filter_words(rest.filter("encode"), level, bits, hashes), f"filter_{level}")
            self.levels.append((words, bits, hashes))
            wrong = rest.filter(~F.col("encode") & contains(words.scalar(), F.col("key"), level, bits, hashes))
            rest = common.table(rest.filter("encode").select("key", F.lit(False).alias("encode")).unionByName(wrong.select("key", F.lit(True).alias("encode"))), f"left_{level}")

    def __call__(self, key: Column) -> Column:
        """Whether a key of the universe is listed: decided by the first level that lacks it."""
        says = None
        for i, (words, bits, hashes) in enumerate(self.levels):
            misses = ~contains(words.scalar(), key, i, bits, hashes)
            says = F.when(misses, F.lit(i % 2 == 1)) if says is None else says.when(misses, F.lit(i % 2 == 1))
        return F.lit(False) if says is None else says.otherwise(F.lit(len(self.levels) % 2 == 1))


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", rules=RULES, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """Add host, path, rule, listed and verdict to every row of pages; columns of those names are replaced.

    `listed` has one column, `key`: host and path joined. A rule's verdict holds where one fits; else a listed key is blocked and any
    other allowed. Null urls and urls without `://` have an empty host, path and key. Null keys in `listed` are ignored, repeated
    ones count once, an empty list blocks nothing. Repeated rows of pages stay. Filters are all that is sent to the executors, and no
    rows are joined. A list whose first filter would exceed max_filter_bytes is dealt by hash to several cascades, built and applied
    one after the other, each to its own part of the rows: then the rows are written once by part and the results are read back, so
    that no more than one cascade is in use at a time.
    """
    common.need(pages, url)
    host, path = host_path(F.col(url).cast("string"))
    rows = pages.withColumns({"__host": host, "__path": path}).drop("host", "path", "rule", "listed", "verdict").withColumnsRenamed({"__host": "host", "__path": "path"})
    key = F.concat("host", "path")
    marked = rows.select(key.alias("key"), F.lit(False).alias("listed")).unionByName(listed.select(F.col("key").cast("string").alias("key"), F.lit(True).alias("listed")))
    keys = common.table(marked.filter("key is not null").groupBy("key").agg(F.max("listed").alias("listed")), "universe")
    sizes = keys.agg(F.count_if("listed").alias("held"), F.count_if(~F.col("listed")).alias("others")).first()
    parts = math.ceil(shape(sizes["held"], sizes["others"])[0] / 8 / max_filter_bytes)
    if parts == 1:
        rows = rows.withColumn("listed", Cascade(keys)(key))
    else:
        rows = in_parts(rows, keys, key, parts)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow"))})


def in_parts(rows: DataFrame, keys: DataFrame, key: Column, parts: int) -> DataFrame:
    """rows with `listed`, by one cascade after another."""
    names = list(rows.columns)
    mark = next(n for i in range(len(names) + 1) if (n := f"__part{i}") not in names)
    part_of = lambda k: F.pmod(F.xxhash64(F.lit("part"), k), F.lit(parts)).cast("int")
    dealt = common.table(rows.withColumn(mark, part_of(key)), "dealt", mark)
    universe = common.table(keys.withColumn(mark, part_of(F.col("key"))), "parts", mark)
    done = []
    for number in range(parts):
        with common.passing() as keep:
            cascade = Cascade(universe.filter(F.col(mark) == number).drop(mark))
            own = dealt.filter(F.col(mark) == number).select(*names)
            done.append(keep(common.table(own.withColumn("listed", cascade(key)), "judged")))
    common.discard(dealt, universe)
    return reduce(DataFrame.unionByName, done)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block list is made of the keys that some page has with a campaign tag (`utm_source=`) in its query."""
    common.ship(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    host, path = host_path(F.col("url"))
    listed = pages.filter(F.col("url").contains("utm_source=")).select(F.concat(host, path).alias("key"))
    return judge(pages, listed).select("page_id", "host", "path", "rule", "verdict", "listed")


_FITS = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')"
_ORDERED = [(v, r, _FITS.format(h=r.partition("/")[0], p=r.partition("/")[2])) for v, r in sorted(RULES, key=lambda r: -len(r[1]))]

ORACLES = {
    "op5_url_filter": f"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, url, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM cut
), parts AS (
  SELECT page_id, url, translate(raw_host, '{UPPER}', '{LOWER}') AS host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM split
), listed AS (
  SELECT DISTINCT host || path AS k FROM parts WHERE contains(url, 'utm_source=')
), judged AS (
  SELECT page_id, host, path, (host || path) IN (SELECT k FROM listed) AS listed,
         CASE {' '.join(f"WHEN {f} THEN '{r}'" for _, r, f in _ORDERED)} END AS rule,
         CASE {' '.join(f"WHEN {f} THEN '{v}'" for v, _, f in _ORDERED)} END AS says
  FROM parts
)
SELECT page_id, host, path, rule, COALESCE(says, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM judged
"""
}
QUERIES = {"op5_url_filter": op5_url_filter}
