"""Runs against a plain walk through each group."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomwork.operators.runs import numbered_runs


def plainly(rows, starts):
    out, last, n = {}, {}, {}
    for k, i, v in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1])):
        n[k] = n.get(k, 0) + bool(starts(last.get(k), v))
        last[k] = v
        out[k, i] = n[k]
    return out


@pytest.mark.parametrize("partitions", ["1", "7", "40"])
def test_runs(spark, tmp_path, partitions):
    """A group over many ranges, ranges of many groups, null groups, and values that are null."""
    rng = random.Random(2)
    rows = [("hot", i, rng.choice([0, 0, 1, None])) for i in range(700)] + [(rng.choice(["a", "b", None, "zz"]), 1000 + i, rng.choice([0, 1])) for i in range(60)] + [(f"k{i}", i, 1) for i in range(90)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    made = []

    def cut(df, name):
        made.append(f"{tmp_path}/{len(made)}")
        df.write.parquet(made[-1])
        return spark.read.schema(df.schema).parquet(made[-1])

    try:
        df = spark.createDataFrame(rows, "k string, i long, v int").repartition(5)
        island = numbered_runs(df, "k", ["i"], F.col("v"), lambda b, v: (v == 1) & ~F.coalesce(b == 1, F.lit(False)), "n", cut)
        assert {(r.k, r.i): r.n for r in island.collect()} == plainly(rows, lambda b, v: v == 1 and b != 1)
        gap = numbered_runs(df, "k", ["i"], F.col("i"), lambda b, i: b.isNull() | (i - b > 3), "n", cut)
        assert {(r.k, r.i): r.n for r in gap.collect()} == plainly([(k, i, i) for k, i, _ in rows], lambda b, i: b is None or i - b > 3)
        assert numbered_runs(df.filter("false"), "k", ["i"], F.col("v"), lambda b, v: v == 1, "n", cut).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
