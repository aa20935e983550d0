"""Edits against the plain table of distances."""

from __future__ import annotations

import random
import time
from functools import cache

import pytest
from pyspark.sql import functions as F

from loomwork.functions import edits, metrics


def table(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def possible(a, b) -> set[tuple[int, int, int]]:
    """Substitutions, deletions and insertions of all alignments with the fewest edits."""

    @cache
    def of(i: int, j: int) -> frozenset:
        if not i or not j:
            return frozenset({(0, i, j)})
        ways = [(s + (a[i - 1] != b[j - 1]), d, n) for s, d, n in of(i - 1, j - 1)] + [(s, d + 1, n) for s, d, n in of(i - 1, j)] + [(s, d, n + 1) for s, d, n in of(i, j - 1)]
        least = min(map(sum, ways))
        return frozenset(w for w in ways if sum(w) == least)

    return set(of(len(a), len(b)))


def pairs(n: int, most: int):
    rng = random.Random(n)
    for _ in range(n):
        letters = "ab" if rng.random() < 0.4 else "abcdefɛ"
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(most)))
        b = "".join(rng.choice(letters) for _ in range(rng.randrange(most))) if rng.random() < 0.5 else "".join(c for c in a if rng.random() < 0.8) + rng.choice(["", "x", "ab"])
        yield a, b


def test_distances():
    for a, b in [*pairs(400, 12), *pairs(60, 150), ("", ""), ("", "abc"), ("abc", "")]:
        assert edits.distance(a, b) == table(a, b) == edits.distance(list(b), list(a))


@pytest.mark.parametrize("bits", [1, 40, 1 << 28])
def test_operations(monkeypatch, bits):
    """Also when pairs are halved down to single elements."""
    monkeypatch.setattr(edits, "BITS", bits)
    for a, b in [*pairs(250, 12), ("", "ab"), ("ab", "")]:
        assert edits.operations(a, b) in possible(a, b)
    for a, b in pairs(30, 150):
        s, d, n = edits.operations(a, b)
        assert s + d + n == table(a, b) and d - n == len(a) - len(b)


def test_long_texts():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    a = [rng.choice(words) for _ in range(20_000)]
    b = [w if rng.random() < 0.7 else rng.choice(words) for w in a if rng.random() < 0.9]
    began = time.process_time()
    far = edits.distance(a, b)
    took = time.process_time() - began
    s, d, n = edits.operations(a, b)
    assert s + d + n == far and d - n == len(a) - len(b)
    assert took < 3  # 0.4 s on a free machine


def test_columns(spark, monkeypatch):
    rows = [*pairs(60, 30), (None, "a"), ("a", None), ("", "a b"), ("a b", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string").repartition(3)
    words = lambda c: metrics.words(F.regexp_replace(c, "(.)", "$1 "))
    got = df.select("i", "a", "b", edits.distance_of("a", "b").alias("d"), edits.operations_of("a", "b").alias("o"), edits.distance_of(words("a"), words("b")).alias("w")).collect()
    for r in got:
        if r.a is None or r.b is None:
            assert r.d is None and r.o is None and r.w is None
        else:
            assert r.d == table(r.a, r.b) == sum(r.o) and r.o.deletions - r.o.insertions == len(r.a) - len(r.b)
            assert r.w == table(r.a.replace(" ", ""), r.b.replace(" ", ""))
    short = metrics.word_edits(words("a"), words("b"))
    want = {r.i: (r.n, r.c) for r in df.select("i", short.alias("n"), metrics.char_edits(F.col("a"), F.col("b")).alias("c")).collect()}
    monkeypatch.setattr(metrics, "CELLS", 20)  # from here most pairs count as long
    long = metrics.word_edits(words("a"), words("b"))
    assert {r.i: (r.n, r.c) for r in df.select("i", long.alias("n"), metrics.char_edits(F.col("a"), F.col("b")).alias("c")).collect()} == want
