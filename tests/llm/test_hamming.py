"""The index against brute force: recall, exact distances, every code within the radius, and how much is searched."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import hamming


def fit(v) -> bool:
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows: list[tuple], asked: list[tuple], k: int) -> dict[tuple, list[tuple]]:
    rows = [(i, v) for i, v in rows if fit(v) and i is not None]
    width = max((len(v) for _, v in [*rows, *asked] if v), default=1)
    wide = lambda v: np.array([*v, *[0.0] * (width - len(v))], float)
    x, out = np.array([wide(v) for _, v in rows]).reshape(len(rows), width), {}
    for q, v in asked:
        if fit(v) and q is not None:
            far = np.sqrt(((x - wide(v)) ** 2).sum(axis=1))
            best = sorted((d, i) for d, (i, _) in zip(far.tolist(), rows, strict=True) if i != q)[:k]
            out[q] = [(n + 1, i, d) for n, (d, i) in enumerate(best)]
    return out


def of(df) -> dict[tuple, list[tuple]]:
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (str(r.query_id), r.rank)):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def recall(got: dict, want: dict) -> float:
    """The share of the wanted rows that were found; what was found is at its true distance and in order."""
    for q, found in got.items():
        assert [n for n, _, _ in found] == list(range(1, len(found) + 1)) and len(found) == len(want[q])
        assert found == [(n + 1, i, d) for n, (d, i) in enumerate(sorted((d, i) for _, i, d in found))]
    return sum(len({i for _, i, _ in got.get(q, [])} & {i for _, i, _ in rows}) for q, rows in want.items()) / max(1, sum(map(len, want.values())))


def test_embeddings(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute(rows, [r for r in rows if r[0] % 100 == 0], 10)
    got = of(hamming.op13_hamming_search(spark, sf_dir))
    assert got.keys() == want.keys() and recall(got, want) >= 0.95


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("VECTOR_ROWS", 40), ("CODE_ROWS", 60), ("QUERY_ROWS", 7), ("SAMPLE", 200), ("CELLS", 500), ("MOST_PREFIX", 8)):
        monkeypatch.setattr(hamming, name, value)


def test_every_code_within_the_radius(spark, small_blocks, monkeypatch):
    """With a given projection and radius, the rows found are the nearest of all rows whose codes are within it."""
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((12, 24))
    x = (centre[rng.integers(0, 12, 900)] + 0.3 * rng.standard_normal((900, 24))).astype(float)
    projection = rng.standard_normal((24, hamming.BITS))
    monkeypatch.setattr(hamming, "SAMPLE", 1000)
    monkeypatch.setattr(hamming, "learn_rotation", lambda x, bits: (np.zeros(24), projection))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    codes = hamming.binary(x, np.zeros(24), projection)
    bits = hamming.apart(codes, codes).astype(int)
    for radius in (3, 22, 41, 128):
        monkeypatch.setattr(hamming, "learn_radii", lambda *a, r=radius: ([1e9], [r]))
        got = of(hamming.nearest(df, df.filter("vec_id % 30 = 0"), k=3))
        for q in range(0, 900, 30):
            least = sorted(np.delete(bits[q], q))[2]
            inside = [i for i in range(900) if i != q and bits[q, i] <= max(radius, least)]
            far = hamming.distances(x[q], x)
            assert got[q] == [(n + 1, i, d) for n, (d, i) in enumerate(sorted((far[i], i) for i in inside)[:3])]


def test_shares_of_the_radius():
    """Two codes within r differ by a substring's share at most in one substring at least; shares can't be smaller in all."""
    parts = hamming.BITS // hamming.PART
    for r in range(hamming.BITS):
        shares = [int(hamming.part_radii(np.array([r]), p)[0]) for p in range(parts)]
        assert sum(s + 1 for s in shares) == r + 1  # any way to deal out r bits leaves one substring within its share


@pytest.mark.parametrize(("spread", "most"), [(0.05, 0.03), (0.2, 0.06), (0.5, 0.12)])
def test_little_is_searched_in_clusters(spread, most):
    """Share of the rows within the radius that a tight bound gives, on 50 clusters of 64 dimensions."""
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((50, 64)) / 8
    x = centre[rng.integers(0, 50, 8000)] + spread * rng.standard_normal((8000, 64)) / 8
    mean, projection = hamming.learn_rotation(x[:2000], hamming.BITS)
    codes = hamming.binary(x, mean, projection)
    edges, radii = hamming.learn_radii(x[:2000], codes[:2000], hamming.RECALL)
    found = searched = total = 0
    for q in range(0, 8000, 100):
        far = hamming.distances(x[q], x)
        far[q] = np.inf
        order = np.argsort(far)[:10]
        radius = [*radii, hamming.BITS][int(np.searchsorted(edges, far[order[-1]], side="left"))]
        inside = hamming.apart(codes[q : q + 1], codes)[0] <= radius
        found, searched, total = found + inside[order].sum(), searched + inside.mean(), total + 1
    assert found >= 0.93 * 10 * total
    assert searched / total <= most


def test_cases(spark, small_blocks):
    rng = random.Random(5)
    centre = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.3) for c in centre[i % 6]]) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(250)]  # one hot vector: ties go to smaller ids
    rows += [(1000, None), (1001, []), (1002, [1.0, None]), (1003, [float("nan")] * 8), (1004, [float("inf")] * 8), (1005, [0.0] * 8), (1006, [-1.0] * 8), (1007, [0.5] * 3), (None, [1.0] * 8)]
    asked = [r for r in rows if r[0] is None or r[0] % 20 == 0 or r[0] > 999]
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame(rows, schema).repartition(3)
    other = df.select("*", *(F.lit("x").alias(c) for c in ("v", "code", "home", "block", "query_id", "rank", "score", "radius", "run", "lot", "bound", "least", "u")))
    want = brute(rows, asked, 10)
    got = of(hamming.nearest(other, spark.createDataFrame(asked * 2, schema)))
    assert got.keys() == want.keys() and recall(got, want) >= 0.93
    hot = [q for q in want if q is not None and 400 <= q < 650]
    assert hot and all(got[q] == want[q] for q in [0, *hot])
    twice = df.unionByName(df.filter("vec_id = 7"))
    assert [i for _, i, _ in of(hamming.nearest(twice, df.filter("vec_id = 13"), k=700))[13]].count(7) == 2
    keys = lambda d: d.withColumn("vec_id", F.col("vec_id").cast("string"))
    assert {int(q) for q in of(hamming.nearest(keys(df), keys(df.filter("vec_id % 20 = 0"))))} == {q for q in want if q % 20 == 0}


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0, 2.0]), (100, [4.0, 6.0]), (200, [1.0, 2.0])], schema)
    assert of(hamming.nearest(df, df)) == {0: [(1, 200, 0.0), (2, 100, 5.0)], 100: [(1, 0, 5.0), (2, 200, 5.0)], 200: [(1, 0, 0.0), (2, 100, 5.0)]}
    assert hamming.nearest(df.filter("false"), df).count() == hamming.nearest(df, df.filter("false")).count() == 0
    assert hamming.nearest(df.limit(1), df.limit(1)).count() == 0
