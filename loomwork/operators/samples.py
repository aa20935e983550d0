"""Samples of an exact size, and sources interleaved by weight: both in an order that a seed and the rows' keys decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a row's number, and those that a round looks at.
BITS, ROUND = 60, 12
#: A range with at most so many rows is sorted instead of being looked at once more.
FEW = 10_000


def hashed(seed: str, *parts: Column, bits: int = BITS) -> Column:
    """A number of up to 60 bits from the MD5 of seed and parts, joined by colons; a null part is an empty one."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, bits // 4), 16, 10).cast("long")


def exact_sample(df: DataFrame, caps: int | Column, key: str, by: str | None = None, seed: str = "sample", cut=lambda df, name: df) -> DataFrame:
    """min(cap, rows) rows of df, or of each value of its column `by`: those with the smallest hashes of seed and key, at equal ones the smallest keys.

    `caps` is a number, or a column of `by`; null takes none. A null in `by` is a value. Keys tell rows apart: rows that share one are
    taken in any order among themselves, and by one task if the sample ends among them.

    The last hash that is in is found by rounds: rows are counted by their next ROUND bits, within the range that the last row is known
    to be in. Nothing is sorted but the rows of a range of FEW at most."""
    rows = df.withColumns({"__by": F.lit(None).cast("string") if by is None else F.col(by), "__h": hashed(seed, F.col(key))})
    small = cut(rows.select("__by", "__h"), "hashes")
    cap = F.lit(caps) if isinstance(caps, int) else caps
    sizes = small.groupBy(F.col("__by").alias(by or "__by")).agg(F.count("*").alias("__size"))
    state = sizes.select(F.col(by or "__by").alias("__of"), F.lit(0).cast("long").alias("__prefix"), F.when(cap.isNotNull(), F.least(cap, F.col("__size"))).cast("long").alias("__need"), "__size")
    state = cut(state.filter("__need > 0"), "ranges")
    used = 0
    while used < BITS and (state.agg(F.max(F.when(F.col("__need") < F.col("__size"), F.col("__size")))).first()[0] or 0) > FEW:
        used += ROUND
        near = small.join(state, F.expr("__by <=> __of")).filter(F.shiftright("__h", BITS - used + ROUND) == F.col("__prefix"))
        counts = near.groupBy("__of", "__need", F.shiftright("__h", BITS - used).alias("__prefix")).agg(F.count("*").alias("__size"))
        before = F.coalesce(F.sum("__size").over(Window.partitionBy("__of").orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        state = cut(counts.withColumn("before", before).filter((F.col("before") < F.col("__need")) & (F.col("before") + F.col("__size") >= F.col("__need"))).select("__of", "__prefix", (F.col("__need") - F.col("before")).alias("__need"), "__size"), f"ranges{used}")
    met = rows.join(state, F.expr("__by <=> __of")).withColumn("__place", F.shiftright("__h", BITS - used))
    inside = met.filter((F.col("__place") < F.col("__prefix")) | ((F.col("__place") == F.col("__prefix")) & (F.col("__need") == F.col("__size"))))
    edge = met.filter((F.col("__place") == F.col("__prefix")) & (F.col("__need") < F.col("__size")))
    first = F.row_number().over(Window.partitionBy("__by").orderBy("__h", key))
    last = edge.withColumn("__rank", first).filter(F.col("__rank") <= F.col("__need"))
    return inside.select(*df.columns).unionByName(last.select(*df.columns))


def numbered_within(df: DataFrame, by: str, key: str, name: str, width: int = 1 << 16) -> DataFrame:
    """Add `name`: 0, 1, … in each value of `by` (null is one), in the order of `key`, a whole number without nulls.

    Rows are numbered in ranges of `width` key values; only the ranges' sizes pass through one task for each value."""
    ranges = df.withColumn("__range", F.floor(F.col(key) / width))
    sizes = ranges.groupBy(F.col(by).alias("__of"), F.col("__range").alias("__from")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__of").orderBy("__from").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__of", "__from", F.coalesce(before, F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy(by, "__range").orderBy(key)) - 1
    joined = ranges.withColumn("__own", own).join(starts, F.expr(f"`{by}` <=> __of and __range = __from"))
    return joined.withColumn(name, F.col("__start") + F.col("__own")).select(*df.columns, name)


def ordered(df: DataFrame, order: list[str], name: str, cut) -> DataFrame:
    """Add `name`: 1, 2, … over all of df, in an order without ties. Rows are dealt to ranges and numbered there; only the ranges'
    sizes, one row for each, pass through one task."""
    ranged = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ordered")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.withColumn("__own", own).join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__own")).select(*df.columns, name)


def interleaved(df: DataFrame, source: str, weight: Column, key: str, seed: str = "mix", cut=lambda df, name: df) -> DataFrame:
    """df's columns with copy (0 for a row's first) and place (1, 2, … without gaps): sources drawn in turn by weight, until the one that
    lasts longest has been drawn as a whole. Shorter ones begin again.

    `weight` is a positive column of `source` (null is a source); weights need not sum to 1. A source's draw number j takes place at
    the time (j + u) / w, with its share w and a hash u of seed, source and j from 0 to 1; draws are placed by time, then source. So
    after N draws, of S sources, a source has been drawn within 1 + w S of w N times, whatever N. Each pass through a source is in
    the order of `key`, a whole number without nulls that differs between a source's rows.

    A source's rows are numbered in ranges of keys and all draws in ranges of time: no source, and no order, is in one task."""
    numbers = numbered_within(df, source, key, "__row")
    sizes = numbers.groupBy(F.col(source)).agg(F.count("*").alias("__n")).withColumn("__w", weight.cast("double"))
    total = sizes.agg(F.sum("__w")).first()[0]
    if total is None:
        return df.select("*", F.lit(0).alias("copy"), F.lit(0).cast("long").alias("place")).filter("false")
    shares = cut(sizes.select(F.col(source).alias("__source"), "__n", (F.col("__w") / total).alias("__w")), "shares")
    jitter = lambda name, j: hashed(seed, name, j, bits=32).cast("double") / float(1 << 32)
    time = lambda name, j: (j + jitter(name, j)) / F.col("__w")
    name = F.col("__source")
    end = shares.agg(F.max(F.struct(time(name, F.col("__n") - 1).alias("at"), F.coalesce(name.cast("string"), F.lit("")).alias("name")))).first()[0]
    met = numbers.join(shares, F.expr(f"`{source}` <=> __source"))
    passes = F.floor(end["at"] * F.col("__w") / F.col("__n")).cast("int") + 1
    draws = met.withColumn("copy", F.explode(F.sequence(F.lit(0), passes))).withColumn("__j", F.col("__row") + F.col("copy") * F.col("__n"))
    draws = draws.withColumn("__at", time(name, F.col("__j"))).withColumn("__name", F.coalesce(name.cast("string"), F.lit("")))
    until = (F.col("__at") < end["at"]) | ((F.col("__at") == end["at"]) & (F.col("__name") <= end["name"]))
    return ordered(draws.filter(until).select(*df.columns, "copy", "__at", "__name"), ["__at", "__name"], "place", cut).select(*df.columns, "copy", "place")
