"""Exact samples and interleaved sources, against plain Python."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from loomwork.operators import samples


def number(*parts, bits=60) -> int:
    return int(hashlib.md5(":".join("" if p is None else str(p) for p in parts).encode()).hexdigest()[: bits // 4], 16)


@pytest.mark.parametrize("few", [1, 50, 10_000])
def test_exact_sample(spark, monkeypatch, few):
    """With ranges refined to the last row, or hardly."""
    monkeypatch.setattr(samples, "FEW", few)
    df = spark.range(3000).select(F.col("id").alias("k"), F.lit("x").alias("prefix")).repartition(4)
    for n in (0, 1, 7, 100, 2999, 3000, 5000):
        got = samples.exact_sample(df, n, "k")
        assert got.columns == df.columns
        assert sorted(r.k for r in got.collect()) == sorted(sorted(range(3000), key=lambda k: (number("sample", k), k))[:n])


def test_caps_for_each_split(spark, monkeypatch):
    monkeypatch.setattr(samples, "FEW", 5)
    rows = [(i, [None, "a", "b", "b", "b", "c", "none"][i % 7]) for i in range(1400)]
    df = spark.createDataFrame(rows, "k long, s string").repartition(3)
    caps = {None: 11, "a": 10_000, "b": 130, "c": 0}
    cap = F.when(F.col("s").isNull(), 11).when(F.col("s") == "a", 10_000).when(F.col("s") == "b", 130).when(F.col("s") == "c", 0)
    got = {(r.k, r.s) for r in samples.exact_sample(df, cap, "k", by="s", seed="z").collect()}
    want = set()
    for s, n in caps.items():
        want |= {(k, s) for k in sorted((k for k, x in rows if x == s), key=lambda k: number("z", k))[:n]}
    assert got == want
    assert samples.exact_sample(df.filter("false"), 5, "k").count() == 0


def test_keys_of_any_number(spark, monkeypatch):
    """Repeated keys: still the exact size."""
    monkeypatch.setattr(samples, "FEW", 5)
    df = spark.range(900).select((F.col("id") % 3).alias("k"), "id")
    for n in (1, 300, 301, 899):
        assert samples.exact_sample(df, n, "k").count() == n


def plainly(rows, weights):
    sources = sorted({s for _, s in rows}, key=lambda s: s or "")
    own = {s: sorted(k for k, x in rows if x == s) for s in sources}
    total = sum(weights[s] for s in sources)
    share = {s: weights[s] / total for s in sources}
    at = lambda s, j: (j + number("mix", s, j, bits=32) / 2**32) / share[s]
    end = max((at(s, len(own[s]) - 1), s or "") for s in sources)
    draws = []
    for s in sources:
        j = 0
        while j - 1 <= end[0] * share[s]:
            if (at(s, j), s or "") <= end:
                draws.append((at(s, j), s or "", own[s][j % len(own[s])], s, j // len(own[s])))
            j += 1
    return [(k, s, c, i) for i, (_, _, k, s, c) in enumerate(sorted(draws, key=lambda d: d[:2]), 1)], share


@pytest.mark.parametrize("sizes", [{"a": 400, "b": 3, None: 40, "c": 90}, {"a": 1}, {"a": 5, "b": 500}])
def test_interleaved(spark, monkeypatch, sizes):
    weights = {"a": 0.6, "b": 0.25, None: 0.2, "c": 0.15}
    rows, k = [], 0
    for i in range(max(sizes.values())):
        for s, n in sizes.items():
            if i < n:
                rows.append((k, s))
                k += 1 + 40_000 * (k % 50 == 0)
    df = spark.createDataFrame(rows, "k long, s string").withColumn("copied", F.lit("x")).repartition(3)
    weight = F.when(F.col("s") == "a", 0.6).when(F.col("s") == "b", 0.25).when(F.col("s") == "c", 0.15).otherwise(0.2)
    got = sorted(((r.k, r.s, r.copy, r.place) for r in samples.interleaved(df, "s", weight, "k").collect()), key=lambda r: r[3])
    want, share = plainly(rows, weights)
    assert got == want
    assert {k for k, *_ in got} == {k for k, _ in rows}  # every source is drawn as a whole
    seen = dict.fromkeys(share, 0)
    for n, (_, s, _, place) in enumerate(got, 1):
        seen[s] += 1
        assert place == n and all(abs(seen[x] - share[x] * n) < 1 + share[x] * len(share) for x in share)


def test_nothing_to_interleave(spark):
    df = spark.createDataFrame([], "k long, s string")
    assert samples.interleaved(df, "s", F.lit(1.0), "k").count() == 0
