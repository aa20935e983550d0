"""Exact Jaccard join on word n-grams, by partitioning the universe of n-grams into segments.

Two sets whose symmetric difference is at most d agree in one of d + 1 segments, or, if segments are also indexed with any one element
left out, differ by at most one element in such a segment. Sets are banded by size; in a band every n-gram falls by its hash into one
of m segments, and a set is indexed under the hash of each segment's subset. Bands of small sets, where segments hold one or two
elements, also index the subsets with one element left out. A set has more segments than it needs; what it has to spare is spent on
leaving out those that it shares with the most others, as counted over the corpus, in one order for all sets. Candidates are verified
on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomwork.llm import arrays, common
from loomwork.llm.components import components

WORDS = 5
#: Ratio of the sizes at a band's ends, and up to which size a band has one-deletion neighbourhoods.
BAND_RATIO = 1.8
DELETION_SIZE = 64
#: Bytes of text whose sets' index entries fill one bucket, and entries that a task packs at a time.
BUCKET_BYTES = 12_000_000
FLUSH_ENTRIES = 1_000_000
#: An entry is dealt over HOT_SALTS buckets of its own if it makes up one of 2 * HOT_SHARE entries of the corpus and at least HOT_ENTRIES:
#: so there are 2 * HOT_SHARE such entries at most. They are counted on one in HOT_SAMPLE sets.
HOT_SHARE = 1000
HOT_ENTRIES = 100_000
HOT_SALTS = 16
HOT_SAMPLE = 8
#: Bits of the number that stands for a set between index and components; sets that share one are told apart by 64 bits more.
ID_BITS = 64
#: Rounds in which each set of a group with several components is compared with one more set of another.
ROUNDS = 2
#: Groups of more sets than this are compared in blocks of at most BLOCK_GRAMS n-grams (or one set) and BLOCK_SETS sets, smaller ones by pairs.
PAIRED = 32
BLOCK_GRAMS = 100_000
BLOCK_SETS = 6000
#: n-grams whose rows of the block's matrix are multiplied at a time, at most; cells of that matrix, and of the products, held at a time.
MATRIX_COLUMNS = 8192
MATRIX_CELLS = 8_000_000
PRODUCT_CELLS = 2_000_000
#: Comparisons with one set that a task makes in a row.
CENTRE_PAIRS = 200

_U = np.uint64
_VALUE, _SEGMENT, _CHECK = _U(0xA24BAED4963EE407), _U(0x9FB21C651E98DF25), _U(0xC2B2AE3D27D4EB4F)


def shingle_sets(texts: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's n-grams, and the offsets of each text's. Fewer than n words count as one n-gram."""
    words, offsets = arrays.split_words(pc.ascii_lower(texts))
    index, distinct = arrays.encoded(words)
    hashes = arrays.hash_strings(distinct)[index]
    found, at = arrays.grams(hashes, offsets, n)
    sizes = np.diff(offsets)
    if len(short := np.flatnonzero((sizes > 0) & (sizes < n))):
        own = np.zeros(len(short), np.uint64)
        for k in range(1, n):  # order counts: fold the words from the left
            rows = short[sizes[short] == k]
            if len(rows):
                h = np.full(len(rows), k, np.uint64)
                for j in range(k):
                    h = arrays.mix(h * _VALUE + hashes[offsets[rows] + j])
                own[np.searchsorted(short, rows)] = h
        counts = np.diff(at)
        counts[short] = 1
        grown = np.concatenate([[0], np.cumsum(counts)])
        whole = np.empty(grown[-1], np.uint64)
        mask = np.ones(len(whole), bool)
        mask[grown[short]] = False
        whole[mask], whole[~mask] = found, own
        found, at = whole, grown
    for s, e in zip(at[:-1], at[1:], strict=True):
        found[s:e].sort()
    rows = arrays.row_of(at)
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])
    before = np.concatenate([[0], np.cumsum(fresh)])
    return found[fresh], before[at]


def set_ids(hashes: np.ndarray, offsets: np.ndarray, salt: np.uint64 = _VALUE) -> np.ndarray:
    """A 64-bit hash of each whole set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(arrays.mix(hashes ^ salt))])
    return arrays.mix(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64) * _SEGMENT).view(np.int64)


def numbers(hashes: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """cls, the number that stands for each set, and check, 64 bits more of its hash."""
    return set_ids(hashes, offsets) >> (64 - bits), set_ids(hashes, offsets, _CHECK)


def bands(largest: int) -> np.ndarray:
    """Each band's largest size, up to a band with `largest`."""
    out, low = [], 1
    while not out or out[-1] < largest:
        out.append(max(low, int(low * BAND_RATIO)))
        low = out[-1] + 1
    return np.array(out, np.int64)


def segments(top: np.ndarray) -> np.ndarray:
    """Segments of a band: enough that the filled ones exceed the differences allowed by several standard deviations."""
    return np.ceil(0.4 * top + 2 * np.sqrt(top) + 2).astype(np.int64)


class Signatures:
    """Index entries of the sets of a slice in each band that they take part in: their own and, if a set of the band below can be similar, that one."""

    def __init__(self, hashes: np.ndarray, offsets: np.ndarray, percent: int):
        self.hashes, self.offsets = hashes, offsets
        sizes = np.diff(offsets)
        tops = bands(int(sizes.max(initial=1)))
        band = np.searchsorted(tops, sizes)
        below = tops[np.maximum(band - 1, 0)]
        rows = np.flatnonzero(sizes > 0)
        lower = rows[(band[rows] > 0) & (percent * sizes[rows] <= 100 * below[rows])]
        largest_partner = 100 * sizes // percent
        self.spare = np.full(len(sizes), np.iinfo(np.int64).max)
        self.parts = []
        where = np.repeat(np.arange(len(sizes)), sizes)
        spread = arrays.mix(hashes ^ _SEGMENT)
        value = arrays.mix(hashes + _VALUE)
        for own, level, partner in ((rows, band, largest_partner), (lower, band - 1, np.minimum(largest_partner, below))):
            top = tops[np.maximum(level, 0)]
            m = np.zeros(len(sizes), np.int64)
            m[own] = segments(top[own])
            base = np.concatenate([[0], np.cumsum(m)])
            inside = m[where] > 0
            doc, val = where[inside], value[inside]
            segment = ((spread[inside] >> _U(32)) * m[doc].astype(np.uint64) >> _U(32)).astype(np.int64)
            cell = base[doc] + segment
            total = np.zeros(base[-1], np.uint64)
            np.add.at(total, cell, val)
            count = np.bincount(cell, minlength=base[-1])
            deletes = top <= DELETION_SIZE
            worth = np.where(np.repeat(deletes, m), np.minimum(count, 2), np.minimum(count, 1))
            differ = (100 - percent) * (sizes + partner) // (100 + percent)
            spare = arrays.row_sums(worth, base) - differ - 1
            spare = np.where(deletes & (spare > 0), spare // 2, spare)  # an entry with deletions counts twice
            self.spare[own] = np.minimum(self.spare[own], spare[own])
            self.parts.append((level, m, base, total, count, doc, val, cell, deletes))

    def entries(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of the chosen rows (a mask), and the row of each."""
        out, rows = [], []
        for level, m, base, total, count, doc, val, cell, deletes in self.parts:
            owner = np.repeat(np.arange(len(m)), m)
            salt = (np.arange(len(owner)) - base[owner]).astype(np.uint64) * _SEGMENT + level[owner].astype(np.uint64) * _VALUE
            full = (count > 0) & chosen[owner]
            out.append(arrays.mix(total[full] + salt[full]))
            rows.append(owner[full])
            less = deletes[doc] & chosen[doc] & (count[cell] > 1)
            if less.any():
                out.append(arrays.mix(total[cell[less]] - val[less] + salt[cell[less]]))
                rows.append(doc[less])
        return np.concatenate(out), np.concatenate(rows)


def profile(rows: DataFrame, percent: int) -> DataFrame:
    """key, n, cls and check (hashes of the set, null if empty) and spare: entries that the set can do without (negative: too few to
    be sure). Rows with `sig` and `times`, and nulls else, count the entries of one in HOT_SAMPLE sets that many of them have."""
    bits, share, sample = ID_BITS, 2 * HOT_SHARE, HOT_SAMPLE
    key = rows.schema["key"].dataType
    types = {"key": to_arrow_type(key), "n": pa.int64(), "cls": pa.int64(), "check": pa.int64(), "spare": pa.int64(), "sig": pa.int64(), "times": pa.int64()}

    def row(**columns: pa.Array) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(size, t) for c, t in types.items()], names=list(types))

    def counted(sig: np.ndarray) -> Iterator[pa.RecordBatch]:
        """What makes up one of `share` of the entries, or less: the last row, without `sig`, is the number of all entries."""
        ordered = np.sort(sig)
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        times = np.diff(np.append(starts, len(sig)))
        much = times >= max(2, -(-len(sig) // share))
        yield row(sig=pa.array(ordered[starts[much]].view(np.int64)), times=pa.array(times[much]))
        yield row(times=pa.array([len(sig)], pa.int64()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                hashes, offsets = shingle_sets(arrays.plain(part.column("text")))
                n, (cls, check) = np.diff(offsets), numbers(hashes, offsets, bits)
                signatures = Signatures(hashes, offsets, percent)
                none = n == 0
                yield row(key=part.column("key"), n=pa.array(n), cls=pa.array(cls, mask=none), check=pa.array(check, mask=none), spare=pa.array(signatures.spare, mask=none))
                held.append(signatures.entries((n > 0) & (check % sample == 0))[0])
                if sum(map(len, held)) >= FLUSH_ENTRIES:
                    yield from counted(np.concatenate(held))
                    held = []
        if sum(map(len, held)):
            yield from counted(np.concatenate(held))

    return rows.select("key", "text").mapInArrow(sets, f"key {key.simpleString()}, n long, cls long, check long, spare long, sig long, times long")


def hot_entries(found: DataFrame) -> list[int]:
    """Entries that make up one of 2 * HOT_SHARE of all, and HOT_ENTRIES at least, by what the tasks reported: 2 * HOT_SHARE at most."""
    total = found.filter("n is null and sig is null").agg(F.sum("times")).first()[0] or 0
    least = max(HOT_ENTRIES / HOT_SAMPLE, total / (2 * HOT_SHARE))
    return [r["sig"] for r in found.filter("sig is not null").groupBy("sig").agg(F.sum("times").alias("times")).filter(F.col("times") >= least).select("sig").collect()]


def pack_entries(sig: np.ndarray, cls: np.ndarray, buckets: int, hot: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket: its sets with their numbers of entries, then 48 bits of each entry. Entries come grouped by set.
    Those of `hot` (sorted) lie in HOT_SALTS buckets each, after the others."""
    bucket = (sig % _U(buckets)).astype(np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, sig), len(hot) - 1)
        bucket = np.where(hot[at] == sig, buckets + at * HOT_SALTS + cls % HOT_SALTS, bucket)
    order = np.argsort(bucket, kind="stable")
    bucket, sig, cls = bucket[order], sig[order], cls[order]
    firsts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    sets, counts, packed = [], [], []
    bits = (sig >> _U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    for s, e in zip(firsts, [*firsts[1:], len(sig)], strict=True):
        runs = np.flatnonzero(np.concatenate([[True], cls[s + 1 : e] != cls[s : e - 1]]))
        sets.append(cls[s:e][runs].tobytes())
        counts.append(np.diff(np.append(runs, e - s)).astype("<u4").tobytes())
        packed.append(bits[s:e].tobytes())
    return pa.record_batch([pa.array(bucket[firsts]), pa.array(sets, pa.binary()), pa.array(counts, pa.binary()), pa.array(packed, pa.binary())], names=["bucket", "sets", "counts", "entries"])


def index(rows: DataFrame, buckets: int, hot: list[int], percent: int) -> DataFrame:
    """The entries of all sets, packed by bucket. Copies within a task are indexed once."""
    apart, bits = np.sort(np.array(hot, np.int64).view(np.uint64)), ID_BITS

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                hashes, offsets = shingle_sets(arrays.plain(part.column("text")))
                cls, check = numbers(hashes, offsets, bits)
                chosen = np.zeros(len(cls), bool)
                for i in np.flatnonzero(np.diff(offsets)):
                    if (x := (int(cls[i]), int(check[i]))) not in seen:
                        seen.add(x)
                        chosen[i] = True
                sig, row = Signatures(hashes, offsets, percent).entries(chosen)
                order = np.argsort(row, kind="stable")
                held.append((sig[order], cls[row[order]]))
                size += len(sig)
                if size >= FLUSH_ENTRIES:
                    yield pack_entries(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), buckets, apart)
                    held, size = [], 0
        if size:
            yield pack_entries(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), buckets, apart)

    return rows.select("text").mapInArrow(emit, "bucket long, sets binary, counts binary, entries binary")


def crowds(packed: DataFrame, buckets: int) -> DataFrame:
    """grp, k, cls, entries: the groups of k sets, two or more, that share an entry, each distinct group of a bucket once, and how many
    entries it shares. Of an entry with buckets of its own, each of these gives its members, with the entry's number as `hot`."""

    def collide(key: tuple, table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.int64) for x in table.column("sets").to_pylist()]
        counts = [np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()]
        cls = np.repeat(np.concatenate(sets), np.concatenate(counts))
        if (own := key[0].as_py()) >= buckets:
            cls = np.unique(cls)
            none = pa.nulls(len(cls), pa.int64())
            return pa.table({"hot": np.full(len(cls), (own - buckets) // HOT_SALTS), "grp": none, "k": none, "cls": cls, "entries": none})
        raw = np.frombuffer(b"".join(table.column("entries").to_pylist()), np.uint8).reshape(-1, 6)
        sig = np.zeros((len(raw), 8), np.uint8)
        sig[:, :6] = raw
        sig = sig.view("<u8").ravel()
        order = np.argsort(sig)
        sig, cls = sig[order], cls[order]
        shared = np.zeros(len(sig), bool)
        shared[1:] = sig[1:] == sig[:-1]
        shared[:-1] |= shared[1:]
        sig, cls = sig[shared], cls[shared]
        order = np.lexsort((cls, sig))
        sig, cls = sig[order], cls[order]
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
        sig, cls = sig[fresh], cls[fresh]
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, int)
        sizes = np.diff(np.append(starts, len(sig)))
        grp = np.add.reduceat(arrays.mix(cls.view(np.uint64)), starts) if len(sig) else np.zeros(0, np.uint64)
        starts, sizes, grp = starts[sizes > 1], sizes[sizes > 1], grp[sizes > 1]
        grp, first, times = np.unique(grp, return_index=True, return_counts=True)
        starts, sizes = starts[first], sizes[first]
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        member = np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)
        return pa.table({"hot": pa.nulls(len(member), pa.int64()), "grp": np.repeat(grp.view(np.int64), sizes), "k": np.repeat(sizes, sizes).astype(np.int64), "cls": cls[member], "entries": np.repeat(times, sizes).astype(np.int64)})

    return packed.groupBy("bucket").applyInArrow(collide, "hot long, grp long, k long, cls long, entries long")


def hot_crowds(members: DataFrame) -> DataFrame:
    """As crowds(), of the members (hot, cls) of the entries with buckets of their own: one of those with equal sets stands for all of them."""
    sums = members.groupBy("hot").agg(F.bit_xor(F.xxhash64("cls")).alias("grp"), F.count(F.lit(1)).alias("k"))
    one = sums.filter("k > 1").groupBy("grp", "k").agg(F.min("hot").alias("hot"), F.count(F.lit(1)).alias("entries"))
    return members.select("hot", "cls").join(F.broadcast(one), "hot").select("grp", "k", "cls", "entries")


def with_choice(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of `groups` that their set keeps: each spends what it has to spare on leaving out the largest groups.

    What a set leaves out is the start of its entries in one order of all groups. Of two linked sets each keeps an entry that both
    have; what the one leaves out of these is a start of what the other does, or the other way round, so some entry is kept by both."""
    most = Window.partitionBy("cls").orderBy(F.desc("k"), "grp").rowsBetween(Window.unboundedPreceding, 0)
    kept = groups.join(classes.select("cls", "spare", "n"), "cls").withColumn("sum", F.sum("entries").over(most)).filter(F.col("sum") > F.col("spare"))
    return kept.select("grp", "cls", "entries", "n")


def least_shared(small: Column, large: Column, percent: int) -> Column:
    """Entries that two linked sets both keep, at least. Each keeps one more than it may differ in from its largest partner (the larger,
    if the smaller is of a band below: from the largest set there), and from this partner it differs in fewer.
    (One in bands with deletions, where entries weigh unequally.)"""
    differ = lambda x, y: F.floor((100 - percent) * (x + y) / (100 + percent))
    band_top = F.lit(None).cast("long")
    tops = bands(1 << 40)
    for top in tops[::-1]:
        band_top = F.when(small <= F.lit(int(top)), F.lit(int(top))).otherwise(band_top)
    of_small = differ(small, F.floor(100 * small / percent))
    of_large = differ(large, F.when(large > band_top, F.least(F.floor(100 * large / percent), band_top)).otherwise(F.floor(100 * large / percent)))
    return F.when(small <= DELETION_SIZE, 1).otherwise(F.least(of_small, of_large) + 1 - differ(small, large))


def across(mixed: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of sets in different components that keep entries enough in common to be linked."""
    other = mixed.select("grp", *(F.col(c).alias(f"b_{c}") for c in ("cls", "component", "n")))
    met = mixed.join(other, "grp").filter("component < b_component").filter(100 * F.least("n", "b_n") >= percent * F.greatest("n", "b_n"))
    pairs = met.groupBy(F.col("cls").alias("a"), F.col("b_cls").alias("b"), "n", "b_n").agg(F.sum("entries").alias("shared"))
    return pairs.filter(F.col("shared") >= least_shared(F.least("n", "b_n"), F.greatest("n", "b_n"), percent)).select("a", "b")


def blocks(mixed: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the sets of the groups in `mixed`, enough to connect all linked sets; no pair is emitted that isn't linked.

    Groups with sets in common are put together (a label travels from group to set to group, twice), so that sets that share many
    large groups meet once. The sets of a label are sorted by size and cut into blocks; two blocks meet in one task if their sizes
    allow links, which loads the texts of both and multiplies their incidence matrices."""
    labelled, total = mixed.select("grp", "cls", "n", F.col("grp").alias("label")), mixed.count()
    for _ in range(2):
        spread = common.table(labelled.withColumn("label", F.min("label").over(Window.partitionBy("cls"))), "spread")  # a set has few groups
        labelled = common.with_group(spread, "grp", total, F.min("label").alias("__label")).withColumn("label", F.col("__label")).drop("__label", "__size")
    members = common.running(labelled.select("label", "cls", "n").distinct(), "label", ["n", "cls"], ("grams", F.col("n")), ("sets", F.lit(1)))
    block = F.floor(F.col("grams") / BLOCK_GRAMS + F.col("sets") / BLOCK_SETS)  # the sum bounds both in each block
    members = common.table(members.select("label", "cls", "n", block.alias("block")), "blocked")
    ends = members.groupBy("label", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    later = ends.select("label", F.col("block").alias("later"), F.col("least").alias("later_least"))
    meetings = ends.join(later, "label").filter((F.col("later") >= F.col("block")) & (100 * F.col("most") >= percent * F.col("later_least"))).select("label", "block", "later")
    sides = meetings.select("label", "block", "later", F.explode(F.array_distinct(F.array("block", "later"))).alias("own"))
    dealt = sides.join(members.select("label", F.col("block").alias("own"), "cls"), ["label", "own"]).join(texts, "cls")

    def compare(table: pa.Table) -> pa.Table:
        found = forest(table.column("cls").to_numpy(), *shingle_sets(arrays.plain(table.column("text"))), percent)
        return pa.table({"a": pa.array([int(a) for a, _ in found], pa.int64()), "b": pa.array([int(b) for _, b in found], pa.int64())})

    return dealt.groupBy("label", "block", "later").applyInArrow(compare, "a long, b long").distinct()


def forest(ids: np.ndarray, hashes: np.ndarray, offsets: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """The ids of linked pairs, as many as connect all linked sets. Intersections come from products of 0/1 matrices over the
    n-grams that two sets or more have, some rows and some n-grams at a time; counts stay below 2^24, so single precision is exact."""
    sizes = np.diff(offsets)
    _, column, times = np.unique(hashes, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    shared = times[column] > 1
    row, column = arrays.row_of(offsets)[shared], number[column][shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = int(number[-1]) + 1 if len(number) else 0
    width = min(MATRIX_COLUMNS, max(64, MATRIX_CELLS // max(1, len(sizes))))
    height = max(1, PRODUCT_CELLS // max(1, len(sizes)))
    root, out = list(range(len(sizes))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for top in range(0, len(sizes), height):
        mine, rest = sizes[top : top + height], sizes[top:]
        both = np.zeros((len(mine), len(rest)), np.float32)
        for low in range(0, total, width):
            s, e = np.searchsorted(column, [low, low + width])
            later = row[s:e] >= top
            part = np.zeros((len(rest), width), np.float32)
            part[row[s:e][later] - top, column[s:e][later] - low] = 1
            both += part[: len(mine)] @ part.T
        both = both.astype(np.int64)
        union = mine[:, None] + rest[None, :] - both
        first, second = np.nonzero(np.triu((100 * both >= percent * union) & (union > 0), 1))
        known = np.array([find(i) for i in range(top, len(sizes))])
        apart = known[first] != known[second]
        for i, j in zip((first[apart] + top).tolist(), (second[apart] + top).tolist(), strict=True):
            i, j = find(i), find(j)
            if i != j:
                root[j] = i
                out.append((ids[i], ids[j]))
    return [(a, b) for a, b in out if a != b]


def verify(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of set hashes that are linked. texts: (cls, text). Sets are made anew from the texts; pairs with the same a
    meet in tasks of about CENTRE_PAIRS, so a's text moves once for that many and b's once for each pair."""
    dealt = common.with_group(pairs, "a", pairs.count()).withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("__size") / CENTRE_PAIRS)).cast("int")).drop("__size")
    members = dealt.join(texts.withColumnRenamed("cls", "b"), "b").select("a", "salt", "b", "text")
    centres = dealt.select("a", "salt").distinct().join(texts.withColumnRenamed("cls", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    lined = centres.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                hashes, offsets = shingle_sets(arrays.plain(part.column("text")))
                found = []
                for i, (a, b) in enumerate(zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True)):
                    one = hashes[offsets[i] : offsets[i + 1]]
                    if b is None:
                        centre, own = a, one.copy()
                    elif a == centre and linked(own, one, percent):
                        found.append((a, b))
                if found:
                    a, b = zip(*found, strict=True)
                    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return lined.mapInArrow(compare, "a long, b long").distinct()


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct hashes."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    common_ = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * common_ >= percent * (len(x) + len(y) - common_)


def against_all(rows: DataFrame, few: list[tuple[int, bytes]], percent: int) -> DataFrame:
    """a, cls, check: links between the few given sets and all sets, by comparing them one by one."""
    sets, bits = [(i, np.frombuffer(x, np.uint64)) for i, x in few], ID_BITS

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                hashes, offsets = shingle_sets(arrays.plain(part.column("text")))
                cls, check = numbers(hashes, offsets, bits)
                found = [(i, int(cls[k]), int(check[k])) for k in np.flatnonzero(np.diff(offsets)) for i, x in sets if linked(x, hashes[offsets[k] : offsets[k + 1]], percent)]
                yield pa.record_batch([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["a", "cls", "check"])

    return rows.select("text").mapInArrow(compare, "a long, cls long, check long").distinct()


def unsure_links(rows: DataFrame, classes: DataFrame, texts_of, percent: int, block: int = 500) -> DataFrame | None:
    """Links (a, b) of the sets whose filled segments happen to be too few for the guarantee, and of those that share a number with
    another set (expected: none of either), in blocks against all sets."""
    few = classes.filter("spare < 0 or twice").select("id")
    if few.isEmpty():
        return None

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, offsets = shingle_sets(arrays.plain(batch.column("text")))
            yield pa.record_batch([batch.column("cls"), pa.array([hashes[s:e].tobytes() for s, e in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], names=["cls", "hashes"])

    unsure, links, held = texts_of(few).mapInArrow(sets, "cls long, hashes binary"), None, []
    for r in [*unsure.toLocalIterator(), None]:
        if r is not None:
            held.append((r["cls"], r["hashes"]))
        if held and (r is None or len(held) == block):
            found = against_all(rows, held, percent).join(classes.select("cls", "check", F.col("id").alias("b")), ["cls", "check"]).select("a", "b").filter("a <> b")
            more = common.table(found, "unsure_links")
            links, held = more if links is None else links.unionByName(more), []
    return links


def candidates(rows: DataFrame, classes: DataFrame, hot: list[int], buckets: int, percent: int) -> DataFrame:
    """A table of grp, cls, entries and n: the groups of sets that share an index entry, with those entries that each set keeps."""
    found = crowds(index(rows, buckets, hot, percent), buckets)
    if hot:
        found = common.table(found, "crowds")
        crowded = found.filter("hot is null").select("grp", "k", "cls", "entries").unionByName(hot_crowds(found.filter("hot is not null")))
    else:
        crowded = found.select("grp", "k", "cls", "entries")
    groups = crowded.groupBy("grp", "k", "cls").agg(F.sum("entries").alias("entries"))
    return common.table(with_choice(groups, classes.filter("not twice").select(F.col("id").alias("cls"), "spare", "n")), "choices")


def linked_classes(choices: DataFrame, texts_of, links: DataFrame | None, percent: int) -> DataFrame:
    """(node, component) of the classes that links connect: those of the given `links`, and those found in the groups of `choices`.

    A round's groups are those of the round before that still hold several components, so the tables shrink."""
    where, tested, groups, texts = None if links is None else common.table(components(links, "a", "b"), "components"), None, choices, None
    for number in range(ROUNDS + 1):
        named = groups.withColumn("component", F.col("cls"))
        if where is not None:
            named = groups.join(where.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
            named = common.table(named, f"named_{number}")
        facts = F.min("component").alias("least"), F.max("component").alias("most"), F.min_by("cls", "component").alias("hub")
        mixed = common.with_group(named, "grp", named.count(), *facts).filter("least < most").withColumnRenamed("__size", "k").drop("most")
        mixed, found = common.table(mixed, f"mixed_{number}"), []
        common.discard(groups, named)
        if texts is None:
            texts = common.table(texts_of(mixed.select(F.col("cls").alias("id")).distinct()), "texts")
        if number < ROUNDS:
            star = mixed.filter("component <> least")
            pairs = star.groupBy(F.col("hub").alias("a"), F.col("cls").alias("b")).agg(F.sum("entries").alias("shared"))
        else:
            pairs = across(mixed.filter(F.col("k") <= PAIRED), percent)
            found.append(blocks(mixed.filter(F.col("k") > PAIRED), texts, percent))
        if tested is not None:
            pairs = pairs.join(tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti")
        if number < ROUNDS:
            pairs = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b")
        pairs = common.table(pairs, f"pairs_{number}")
        found = common.table(reduce(DataFrame.unionByName, [*found, verify(pairs, texts, percent)]), f"links_{number}")
        links = found if links is None else links.unionByName(found)
        tested = pairs if tested is None else tested.unionByName(pairs)
        where, groups = common.table(components(links, "a", "b"), "components"), mixed.select("grp", "cls", "entries", "n")
    return where


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """key, n_shingles and component_id of every row: texts are linked when 100 * intersection >= percent * union of their sets of
    5-word shingles (A-Z lower-cased; fewer words: the whole sequence); component_id is the smallest key that links reach.

    Null and empty texts, and texts of white space, have no shingles and are linked with nothing. Repeated rows each get a row; rows
    of one key with different texts are told apart. Null keys are linked like others, but are no component's smallest key unless it
    has no other: then component_id is null. Rows with equal sets are one class; only classes are compared. In groups of sets that
    share index entries each set is compared with one centre; sets that this leaves in different components are then compared with
    each other, in small groups by pairs and in large ones by blocks, so no link between components is lost, but a large group of
    copies costs one comparison a set. Other columns are dropped.
    """
    common.need(df, key, text)
    body = F.col(text).cast("string")
    rows = df.select(F.struct(F.col(key).alias("key"), F.xxhash64(body).alias("hash")).alias("key"), body.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, int(size) // BUCKET_BYTES)
    with common.passing() as keep:
        found = keep(common.table(profile(rows, percent), "profile"))
        sets = found.filter("n is not null").select("key", "n", "cls", "check", "spare")
        total = sets.count()
        classes = sets.filter("n > 0").groupBy("cls", "check").agg(F.min("key").alias("row"), F.min("key.key").alias("least"), F.first("spare").alias("spare"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))
        alike = F.count(F.lit(1)).over(Window.partitionBy("cls")) > 1
        classes = classes.withColumn("twice", alike).withColumn("id", F.when(F.col("twice"), F.xxhash64("cls", "check")).otherwise(F.col("cls")))
        classes = common.table(classes, "classes")
        repeated = not sets.filter("n > 0").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()

        def texts_of(wanted: DataFrame) -> DataFrame:
            """(cls, text) of classes (id), from the row with the least key."""
            which = wanted.join(classes, "id").select(F.col("row").alias("key"), F.col("id").alias("cls"))
            texts = rows.join(which, "key").select("cls", "text")
            return texts.dropDuplicates(["cls"]) if repeated else texts

        choices = candidates(rows, classes, hot_entries(found), buckets, percent)
        where = linked_classes(choices, texts_of, unsure_links(rows, classes, texts_of, percent), percent)
        known = classes.join(where.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        known = common.table(known.select("cls", "check", "component", "least", "copies"), "components")
        known = common.with_group(known, "component", known.count(), F.min("least").alias("component_id"))
        known = keep(common.table(known.select("cls", "check", "component_id", "copies"), "known"))
    some = common.join_counted(sets.filter("n > 0").select("key", "n", "cls", "check"), known, ["cls", "check"], "copies", total)
    none = sets.filter("n = 0").select("key", "n", F.col("key.key").alias("component_id"))
    return some.select("key", "n", "component_id").unionByName(none).select(F.col("key.key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(common.documents(spark, sf_dir))


QUERIES = {"op6_jaccard_join": op6_jaccard_join}
ORACLES: dict[str, str] = {}
