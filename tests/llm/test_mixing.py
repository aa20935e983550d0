"""Poisson replication against its SQL, its mean, and small cases."""

from __future__ import annotations

import math

from compare import same
from pyspark.sql import functions as F

from loomwork.llm import mixing


def test_documents(spark, sf_dir):
    same(mixing.op4_mixing(spark, sf_dir), sf_dir, mixing.ORACLES["op4_mixing"])


def test_inverse(spark):
    grid = [(u / 500, m / 2) for u in range(500) for m in range(1, 17)]
    rows = spark.createDataFrame(grid, "u double, m double").withColumn("k", mixing.inverse_poisson(F.col("u"), F.col("m"))).collect()
    for r in rows:
        k, term = 0, math.exp(-r.m)
        cdf = term
        while r.u >= cdf:
            k += 1
            term *= r.m / k
            cdf += term
        assert r.k == k


def test_weights_are_met(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 15000, "big").when(F.col("id") < 19900, "mid").otherwise("small").alias("source"))
    got = {r.source: r.n for r in mixing.mix(df, weights={"big": 1, "mid": 1, "small": 2}, total=8000).groupBy("source").agg(F.count("*").alias("n")).collect()}
    for source, want in (("big", 2000), ("mid", 2000), ("small", 4000)):
        assert abs(got[source] - want) < 6 * math.sqrt(want)
    assert set(mixing.mix(df, weights={"mid": 1}).select("source").distinct().toPandas()["source"]) == {"mid"}


def test_cases(cases, clashing, empty):
    out = mixing.mix(cases)
    assert out.select("doc_id", "__copy").exceptAll(mixing.mix(clashing).select("doc_id", "__copy")).count() == 0
    assert mixing.mix(empty).count() == 0
    assert out.select(*cases.columns).distinct().exceptAll(cases.distinct()).count() == 0


def test_many_sources_and_a_null_one(spark, monkeypatch):
    """Too many sources for a broadcast, one of them null with a third of all rows: the same rows as with one."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 1000)).alias("source"))
    one = mixing.mix(df)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    monkeypatch.setattr(mixing.common, "FEW_ROWS", 0)
    many = mixing.mix(df)
    assert many.columns == one.columns and many.count() == one.count() and many.exceptAll(one).count() == 0
    assert abs(one.filter("source is null").count() - one.count() * 1000**0.7 / (1000**0.7 + 667 * 3**0.7)) < 200
    assert mixing.mix(df, weights={"s1": 1}).filter("source is null").count() == 0
