"""URL filters against their SQL, and the cascade's exact membership."""

from __future__ import annotations

from compare import same
from pyspark.sql import functions as F

from loomwork.llm import urls


def test_documents(spark, sf_dir):
    same(urls.op5_url_filter(spark, sf_dir), sf_dir, urls.ORACLES["op5_url_filter"])


def test_cascade_is_exact(spark):
    keys = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 3 == 0).alias("listed"))
    cascade = urls.Cascade(keys)
    assert len(cascade.levels) >= 2
    assert keys.filter(cascade(F.col("key")) != F.col("listed")).count() == 0


def test_cases(spark):
    rows = [
        (1, "http://Sub.Example.ORG/en/15?x#y", "example.org/en/1", "block"),
        (2, "https://example.org/es/", "example.org/es/", "block"),
        (3, "https://example.org/ES/", "org/", "allow"),
        (4, "https://notexample.org/es/1", "org/", "allow"),
        (5, "ftp://a.com/de/1", "com/de/", "block"),
        (6, "a.com/de/1", None, "allow"),
        (7, None, None, "allow"),
        (8, "x://com", None, "allow"),
        (9, "x://com/fr/", "com/fr/", "allow"),
        (10, "http://b.net/p#f", None, "block"),
        (10, "http://b.net/p#f", None, "block"),
        (11, "", None, "allow"),
        (12, "http://a.com?x=/de/", None, "allow"),
    ]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string").select("*", *(F.lit("clash").alias(c) for c in ("host", "path", "rule", "key", "verdict", "listed", "__key", "words")))
    listed = spark.createDataFrame([("b.net/p",), ("b.net/p",), (None,), ("com/unseen",)], "key string")
    for limit in (urls.MAX_FILTER_BYTES, 2):  # one cascade, and several
        got = sorted((r.page_id, r.url, r.rule, r.verdict) for r in urls.judge(pages, listed, max_filter_bytes=limit).collect() if r.page_id)
        assert [(g[0], g[2], g[3]) for g in got] == [(r[0], r[2], r[3]) for r in rows]
    none = urls.judge(pages.filter("false"), listed.filter("false"))
    assert none.count() == 0
    assert urls.judge(pages, listed.filter("false")).filter("listed").count() == 0


def test_parts_give_what_one_cascade_gives(spark, sf_dir):
    """A list dealt to many cascades, with a third of all urls on one key."""
    pages = spark.range(3000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.concat(F.lit("http://h"), F.col("id") % 700, F.lit(".org/p"), "id")).alias("url"), F.col("id").alias("page_id"))
    listed = spark.range(0, 3000, 7).select(F.concat(F.lit("h"), F.col("id") % 700, F.lit(".org/p"), "id").alias("key"))
    one = urls.judge(pages, listed, rules=())
    many = urls.judge(pages, listed, rules=(), max_filter_bytes=256)
    assert many.columns == one.columns
    assert sorted(r.page_id for r in many.filter("listed").collect()) == [i for i in range(0, 3000, 7) if i % 3]
    assert many.count() == 3000 and one.exceptAll(many).count() == 0
