"""Sharding: balanced label propagation between documents with equal texts, under exact row quotas. Built-in functions only."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm import common

SHARDS = 16
ROUNDS = 8
#: Quotas while labels move leave this share of room; the final cut into equal runs takes it back.
SLACK = 0.1
#: A group with a 64th of all rows or more is hot: there are 64 of them at most, so what is known of them can be broadcast.
HOT_PARTS = 64
SALTS = 64
#: Groups larger than a shard (as many as there are shards at most) take no part in the moves; they get labels of their own, after the others.
GIANT_LABELS = 64
#: Rows are ranked within buckets of about this many rows; the table of bucket sizes stays within MAX_BUCKETS rows a shard.
BUCKET_ROWS = 200_000
MAX_BUCKETS = 4096
LINK = ["link", "crc", "size"]


def _unit(*columns: Column) -> Column:
    """A number from 0 to 1 that the columns decide."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _lookup(values: dict[int, float], key: Column, default: float) -> Column:
    if not values:
        return F.lit(default)
    return F.coalesce(F.create_map(*(F.lit(x) for x in chain.from_iterable(values.items())))[key], F.lit(default))


def propagate(blocks: DataFrame, shards: int, rounds: int) -> DataFrame:
    """Move blocks, the rows of a group that began in one shard, towards the shard where most of their group is.

    blocks: (link, crc, size, began, n). A group has at most one block for each shard, so even a group with a third of all rows is a
    few rows here. In each round every block that isn't in its group's largest shard asks to move there; a shard takes the share of
    those that its quota has room for, chosen by a hash of the group. Of equally large shards a hash decides. Adds `shard`.
    """
    blocks = blocks.withColumn("shard", F.col("began"))
    total = blocks.agg(F.sum("n")).first()[0] or 0
    quota = total / shards * (1 + SLACK)
    group = Window.partitionBy(*LINK)
    for number in range(rounds):
        here = F.sum("n").over(Window.partitionBy(*LINK, "shard"))
        wish = blocks.withColumn("here", here).withColumn("best", F.max(F.struct("here", F.xxhash64(*LINK, "shard").alias("order"), "shard")).over(group)).withColumn("wish", F.col("best.shard")).drop("best", "here")
        wish = common.table(wish, f"wishes_{number}")
        flows = wish.groupBy("shard", "wish").agg(F.sum("n").alias("n")).collect()  # shards x shards rows at most
        load = {s: sum(r["n"] for r in flows if r["shard"] == s) for s in range(shards)}
        out = {s: sum(r["n"] for r in flows if r["shard"] == s != r["wish"]) for s in range(shards)}
        into = {s: sum(r["n"] for r in flows if r["wish"] == s != r["shard"]) for s in range(shards)}
        if not any(into.values()):
            break
        accept = {s: max(0.0, min(1.0, (quota - load[s] + out[s]) / into[s])) for s in range(shards) if into[s]}
        moves = (F.col("wish") != F.col("shard")) & (_unit(*map(F.col, LINK), F.lit(number)) < _lookup(accept, F.col("wish"), 0.0))
        blocks = wish.withColumn("shard", F.when(moves, F.col("wish")).otherwise(F.col("shard"))).drop("wish")
    return blocks


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """key, size, text_crc32, shard and slot of every row, by the law of equal row counts: shards differ by one row at most.

    Rows with equal texts are linked. They start in the shard that a hash of the key gives, follow their group by label propagation
    under quotas, and at the end all rows are lined up by shard and group and cut into equal runs: only groups at the 15 borders
    between runs, and groups larger than a shard, are cut apart by that. Those fill whole shards, one after the other. slot counts from 0 within a shard without gaps.
    A null text has size 1, a null CRC and no links; repeated rows are rows of their own, null keys are keys; other columns are dropped. The text is read
    once and never shuffled.
    """
    common.need(df, key, text)
    body = F.col(text).cast("string")
    rows = df.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("size"),
        common.text_crc32(body).alias("crc"),
        F.when(body.isNull(), F.xxhash64(F.lit("null"), F.col(key))).otherwise(F.xxhash64(body)).alias("link"),
    )
    rows = common.table(rows.withColumn("began", F.pmod(F.xxhash64(F.lit("shard"), F.col("key")), F.lit(shards)).cast("int")).withColumn("crc", F.coalesce("crc", F.lit(-1).cast("long"))), "rows")
    total = rows.count()
    blocks = rows.groupBy(*LINK, "began").agg(F.count(F.lit(1)).alias("n"))
    group_n = F.sum("n").over(Window.partitionBy(*LINK))
    linked = common.table(blocks.withColumn("group_n", group_n).filter("group_n > 1"), "blocks")
    giant = F.col("group_n") * shards > total
    moved = propagate(linked.filter(~giant).drop("group_n"), shards, rounds).join(linked.select(*LINK, "began", "group_n"), [*LINK, "began"])
    apart = linked.filter(giant).withColumn("shard", (F.pmod(F.col("link"), F.lit(GIANT_LABELS)) + shards).cast("int"))
    moved = common.table(moved.unionByName(apart), "moved")
    hot_from = max(2, -(-total // HOT_PARTS))
    hot = F.broadcast(moved.filter(F.col("group_n") >= hot_from).select(*LINK, "began", F.col("shard").alias("hot_shard")))
    cool = moved.filter(F.col("group_n") < hot_from).select(*LINK, "began", F.col("shard").alias("cool_shard"))
    placed = rows.join(hot, [*LINK, "began"], "left")
    loose = placed.filter("hot_shard is null").drop("hot_shard").join(cool, [*LINK, "began"], "left").withColumn("label", F.coalesce("cool_shard", "began")).drop("cool_shard").withColumn("salt", F.lit(-1))
    tight = placed.filter("hot_shard is not null").withColumnRenamed("hot_shard", "label").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    buckets = int(min(MAX_BUCKETS, max(8, total // (BUCKET_ROWS * shards))))
    lined = common.table(loose.unionByName(tight).withColumn("bucket", F.pmod(F.col("link"), F.lit(buckets)).cast("int")), "lined")
    place = ["label", "bucket", "salt"]
    sizes = lined.groupBy(*place).agg(F.count(F.lit(1)).alias("n"))  # buckets * shards, and SALTS * HOT_PARTS * shards rows at most
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(*place, F.coalesce("before", F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy(*place).orderBy(*LINK, "key"))
    at = lined.withColumn("rank", rank).join(F.broadcast(before), place).withColumn("at", F.col("before") + F.col("rank") - 1)
    n = F.lit(max(total, 1)).cast("long")
    at = at.withColumn("shard", F.floor(F.col("at") * shards / n).cast("int"))
    first = F.floor((F.col("shard") * n + (shards - 1)) / shards).cast("long")
    crc = F.when(F.col("crc") >= 0, F.col("crc"))
    return at.select(F.col("key").alias(key), "size", crc.alias("text_crc32"), "shard", (F.col("at") - first).alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(common.documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op7_sharding": op7_sharding}
ORACLES: dict[str, str] = {}
