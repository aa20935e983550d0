"""Sharding: even counts, gapless slots, and groups kept together."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from loomwork.llm import sharding


def check(rows, n: int, shards: int = 16) -> None:
    assert len(rows) == n
    counts = Counter(r.shard for r in rows)
    if n:
        sizes = [counts.get(s, 0) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 1
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_documents(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = sharding.op7_sharding(spark, sf_dir).collect()
    check(rows, len(docs))
    groups = defaultdict(set)
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        groups[docs[r.doc_id]].add(r.shard)
    cut = sum(len(x) > 1 for x in groups.values())
    assert cut <= 15  # only groups at the borders between shards


def test_hot_group(spark):
    """A third of all rows have one text: it fills whole shards, and of the 250 other groups nine of ten stay whole under the quotas."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.floor(F.col("id") / 12))).alias("text"))
    rows = sharding.shard(df).collect()
    check(rows, 3000)
    texts = {r.doc_id: r.text for r in df.collect()}
    spread = defaultdict(set)
    for r in rows:
        spread[texts[r.doc_id]].add(r.shard)
    assert len(spread.pop("hot")) <= 7
    assert sum(len(x) > 1 for x in spread.values()) <= 25


def test_cases(cases, clashing, empty):
    check(sharding.shard(cases).collect(), cases.count())
    check(sharding.shard(clashing).collect(), cases.count())
    check(sharding.shard(empty).collect(), 0)
    nulls = sharding.shard(cases).filter("text_crc32 is null").collect()
    assert [r["size"] for r in nulls] == [1]


def spark_hash(*values: int) -> int:
    """Spark's xxhash64 of 64-bit numbers, and of 32-bit ones, which come as tuples of one."""
    h = 42
    for v in values:
        raw = v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
        h = xxhash.xxh64_intdigest(raw, h)
    return h - (1 << 64) if h >> 63 else h


def plain_moves(blocks: dict[tuple, int], shards: int, rounds: int) -> dict[tuple, int]:
    """(link, crc, size, began) -> shard, by moving blocks one after another as the method says."""
    at = {b: b[3] for b in blocks}
    quota = sum(blocks.values()) / shards * (1 + sharding.SLACK)
    for number in range(rounds):
        here = Counter()
        for b, n in blocks.items():
            here[b[:3], at[b]] += n
        best = {}
        for (group, shard), n in here.items():
            best[group] = max(best.get(group, ()), (n, spark_hash(*group, (shard,)), shard))
        wish = {b: best[b[:3]][2] for b in blocks}
        load, out, into = Counter(), Counter(), Counter()
        for b, n in blocks.items():
            load[at[b]] += n
            if wish[b] != at[b]:
                out[at[b]] += n
                into[wish[b]] += n
        if not into:
            break
        accept = {s: max(0.0, min(1.0, (quota - load[s] + out[s]) / into[s])) for s in into}
        for b in blocks:
            if wish[b] != at[b] and spark_hash(*b[:3], (number,)) % (1 << 30) / (1 << 30) < accept[wish[b]]:
                at[b] = wish[b]
    return at


def test_moves_by_a_plain_recount(spark):
    rng = random.Random(12)
    blocks = {}
    for link in range(60):
        group = (rng.randrange(-(2**62), 2**62), rng.randrange(2**32), rng.randrange(1, 500))
        for began in rng.sample(range(4), rng.randrange(1, 5)):
            blocks[(*group, began)] = rng.choice((1, 1, 2, 3, 9))
    df = spark.createDataFrame([(*b, n) for b, n in blocks.items()], "link long, crc long, size long, began int, n long")
    for rounds in (1, 3, 8):
        got = {(r.link, r.crc, r["size"], r.began): r.shard for r in sharding.propagate(df, 4, rounds).collect()}
        assert got == plain_moves(blocks, 4, rounds)


def test_small_groups(spark):
    """Of groups of three only those at the borders between the runs are cut."""
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.floor(F.col("id") / 3)).alias("text"))
    got = sharding.shard(rows, shards=4).collect()
    check(got, 500, 4)
    groups = defaultdict(set)
    for r in got:
        groups[r.doc_id // 3].add(r.shard)
    assert sum(len(x) > 1 for x in groups.values()) <= 3


def test_null_keys(spark):
    check(sharding.shard(spark.createDataFrame([(None, "a"), (None, None), (1, "a"), (None, "a")], "doc_id long, text string")).collect(), 4)
