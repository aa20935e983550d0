"""Exact top-k against all products."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from compare import same
from pyspark.sql import functions as F

from loomwork.llm import knn


def brute(rows: list[tuple], asked: list[tuple], k: int) -> list[tuple]:
    fit = lambda v: bool(v) and all(x is not None and math.isfinite(x) for x in v)
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if fit(v)]
    out = []
    for q, v in asked:
        if fit(v):
            mine = [math.floor(256 * x) for x in v]
            best = sorted((-sum(a * b for a, b in zip(mine, x, strict=False)), i) for i, x in whole if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_embeddings(spark, sf_dir):
    same(knn.op9_exact_top_k(spark, sf_dir), sf_dir, knn.ORACLES["op9_exact_top_k"])


def test_cells_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(knn, "ROWS_A_PIVOT", 10)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 30)
    rng = random.Random(5)
    centre = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.05 if i % 3 else 0.0) for c in centre[i % 6]]) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(150)]  # one hot vector
    rows += [(900, None), (901, []), (902, [1.0, None]), (903, [float("nan")] * 8), (904, [float("inf")] * 8), (905, [0.0] * 8), (906, [-1.0] * 8), (907, [0.5] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit("x")).withColumn("v", F.lit(1))
    asked = df.filter("vec_id % 20 = 0 or vec_id > 899")
    got = sorted(tuple(r) for r in knn.top_k(df, asked).collect())
    assert got == brute(rows, [r for r in rows if r[0] % 20 == 0 or r[0] > 899], 5)


def test_repeated_ids(spark, monkeypatch):
    """Rows, among them queries, that occur many times, and ids with several vectors."""
    monkeypatch.setattr(knn, "ROWS_A_PIVOT", 10)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 30)
    rng = random.Random(6)
    centre = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in centre[i % 6]]) for i in range(300)]
    rows += [rows[i] for i in range(0, 300, 20) for _ in range(i % 9 + 1)]  # repeated queries
    rows += [rows[i] for i in range(7, 300, 31) for _ in range(3)]
    rows += [(i, [c + rng.gauss(0, 0.05) for c in centre[(i + j) % 6]]) for i in (40, 60, 77) for j in range(8)]  # several vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = {(i, tuple(math.floor(256 * x) for x in v)): (i, v) for i, v in rows if i % 20 == 0}
    got = sorted(tuple(r) for r in knn.top_k(df, df.filter("vec_id % 20 = 0")).collect())
    assert got == brute(rows, list(asked.values()), 5)


def searched(x, asked, k=5, rows_a_pivot=knn.ROWS_A_PIVOT):
    """The share of rows in the cells that queries keep, and the blocks that they go to."""
    x = np.floor(x * knn.SCALE)
    cells = knn.Cells(x[np.random.default_rng(1).permutation(len(x))[: max(1, len(x) // rows_a_pivot)]])
    cell, far, length, angle = cells.place(x)
    some = np.unique(cell).tolist()
    sizes = {c: (int((cell == c).sum()), *(float(f[cell == c].max()) for f in (far, length, angle))) for c in some}
    nearest = [(c, int(i), float(far[i])) for c in some for i in np.flatnonzero(cell == c)[np.argsort(far[cell == c], kind="stable")][: k + 1]]
    cells.summarise(sizes, nearest, 500)
    share = blocks = 0.0
    for q in asked:
        own = cells.of_group(int(cell[q]), float(far[[a for a in asked if cell[a] == cell[q]]].max()), k)
        beside = np.sort((x @ x[q])[(cell == cell[q]) & (np.arange(len(x)) != q)])
        kept = cells.of_query(x[q], q, own, cells.entries_of(own), k, beside[-k] if len(beside) >= k else -np.inf)
        inside = np.isin(cell, cells.filled[kept])
        scores = np.delete(x @ x[q], q)
        assert np.isin(np.delete(np.arange(len(x)), q)[scores > np.sort(scores)[-k]], np.flatnonzero(inside)).all()
        share, blocks = share + inside.mean() / len(asked), blocks + len(np.unique(cells.block[kept])) / len(asked)
    return share, blocks / (cells.block.max() + 1)


@pytest.mark.parametrize(("spread", "most"), [(0.05, 0.06), (0.1, 0.12), (0.2, 0.2)])
def test_bounds_prune_clusters(spread, most):
    rng = np.random.default_rng(7)
    centre = rng.standard_normal((50, 64))
    x = centre[rng.integers(0, 50, 12_000)] + spread * rng.standard_normal((12_000, 64))
    share, blocks = searched(x, range(0, 12_000, 400))
    assert share <= most and blocks <= 1


def test_bounds_hold_anywhere():
    """Zero vectors, zero pivots, opposite and long vectors: no row that could matter is left out."""
    rng = np.random.default_rng(8)
    x = np.vstack([rng.standard_normal((300, 6)) * rng.choice([0.01, 1, 50], 300)[:, None], np.zeros((40, 6)), -np.ones((40, 6)), np.ones((40, 6)) * 3])
    for rows_a_pivot in (2, 10, 100, 1000):
        searched(x, range(0, len(x), 7), rows_a_pivot=rows_a_pivot)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (50, [0.5, 0.25])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in knn.top_k(df, df).collect()) == [(0, 1, 50, 128 * 256 + 64 * 512), (50, 1, 0, 128 * 256 + 64 * 512)]
    assert knn.top_k(df.filter("false"), df).count() == 0
    assert knn.top_k(df, df.filter("false")).count() == 0


def test_many_queries_and_pivots_in_two_levels(spark, monkeypatch):
    """One cell with nearly all rows and queries, split on both sides; string keys; a null key."""
    for name, value in (("ROWS_A_PIVOT", 4), ("FANOUT", 8), ("BLOCK_ROWS", 40), ("QUERY_ROWS", 15)):
        monkeypatch.setattr(knn, name, value)
    rng = random.Random(9)
    rows = [(f"k{i:04}", [rng.gauss(0, 1) for _ in range(6)] if i % 9 == 0 else [1 + rng.gauss(0, 1e-3) for _ in range(6)]) for i in range(500)]
    df = spark.createDataFrame([*rows, (None, [1.0] * 6)], "vec_id string, embedding array<double>")
    asked = [r for r in rows if int(r[0][1:]) % 3 == 0]
    got = sorted(tuple(r) for r in knn.top_k(df, df.filter("cast(substring(vec_id, 2, 4) as int) % 3 = 0 or vec_id is null"), k=7).collect())
    assert got == brute(rows, asked, 7)
