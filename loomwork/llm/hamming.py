"""Approximate nearest neighbours: multi-index hashing over learned rotated binary codes, with exact distances at the end."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm import common
from loomwork.llm.knn import matrix

#: Bits of a code, and of each of the substrings that are indexed.
BITS = 128
PART = 32
#: Rotations, the table of radii and each query's first bound are fitted on so many rows at most, and on SAMPLE_VALUES components.
SAMPLE = 4096
SAMPLE_VALUES = 4_000_000
#: Rounds that turn a rotation towards its own signs.
ROUNDS = 30
#: A radius is to hold this share of the rows that are as far as a query's bound; pairs of at least PAIRS rows decide on it.
RECALL = 0.98
STEPS = 64
PAIRS = 400
ASKING = 1024
#: Data rows (of an index block, of a block of vectors) and queries that one local search holds; a block is the rows with the same
#: leading bits of a substring, at least 2^LEAST_PREFIX and at most 2^MOST_PREFIX for each; larger ones are split by hash.
CODE_ROWS = 200_000
VECTOR_ROWS = 20_000
QUERY_ROWS = 5_000
LEAST_PREFIX, MOST_PREFIX = 4, 16
#: Numbers in one intermediate array of a search.
CELLS = 2_000_000


def vectors(df: DataFrame, key: str, column: str) -> DataFrame:
    """vec_id, v: vectors with a key, without null or non-finite components, and with one that isn't zero."""
    x = F.col(column)
    ok = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(x, lambda c: c != 0)
    return df.filter(ok & F.col(key).isNotNull()).select(F.col(key).alias("vec_id"), x.alias("v"))


def learn_rotation(x: np.ndarray, bits: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (width x bits): the principal directions, turned so that the sample's coordinates lie close to their signs
    (iterative quantisation). With more bits than directions, several such rotations from different beginnings."""
    mean = x.mean(axis=0)
    centred = x - mean
    _, directions = np.linalg.eigh(centred.T @ centred)
    take = min(bits, x.shape[1])
    main = directions[:, ::-1][:, :take]
    low = centred @ main
    scale = np.abs(low).max() or 1.0
    rng, out = np.random.default_rng(seed), []
    for _ in range(-(-bits // take)):
        turn, _ = np.linalg.qr(rng.standard_normal((take, take)))
        for _ in range(ROUNDS):
            u, _, w = np.linalg.svd((low / scale).T @ np.where(low @ turn >= 0, 1.0, -1.0))
            turn = u @ w
        out.append(main @ turn)
    return mean, np.hstack(out)[:, :bits]


def binary(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Codes as rows of unsigned 32-bit substrings."""
    return np.packbits((x - mean) @ projection >= 0, axis=1).view(">u4").astype(np.uint32)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of all rows of a from all rows of b."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for i in range(a.shape[1]):
        out += np.bitwise_count(a[:, i, None] ^ b[None, :, i])
    return out


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of one vector from rows, in double precision; equal rows get equal numbers."""
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def learn_radii(x: np.ndarray, codes: np.ndarray, recall: float) -> tuple[list[float], list[int]]:
    """Edges of distance and, for each range up to an edge, the Hamming radius that holds `recall` of the sample's pairs so far apart.

    A range with few pairs is judged with the next ones; radii never fall with distance. Beyond the last edge all codes count."""
    asking = np.linspace(0, len(x) - 1, min(ASKING, len(x))).astype(int)
    far, bits = [], []
    for i in asking:
        far.append(np.delete(distances(x[i], x), i))
        bits.append(np.delete(apart(codes[i : i + 1], codes)[0], i))
    far, bits = np.concatenate(far), np.concatenate(bits)
    if len(far) < PAIRS:
        return [], []
    near, most = np.quantile(far, [0.0, 0.5])
    edges = np.linspace(near, most, STEPS + 1)[1:]
    order = np.argsort(far)
    far, bits = far[order], bits[order]
    starts = np.searchsorted(far, np.concatenate([[-1.0], edges[:-1]]), side="right")
    ends = np.searchsorted(far, edges, side="right")
    radii, most_bits = [], 0
    for a, b in zip(starts, ends, strict=True):
        b = max(b, min(a + PAIRS, len(far)))
        most_bits = max(most_bits, int(np.ceil(np.quantile(bits[a:b], recall))))
        radii.append(most_bits)
    return [float(e) for e in edges], radii


def meet(asking: DataFrame, data: DataFrame, by: str, rows: int, search: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """search() on the queries and the data rows of each block: both sides in runs of bounded size, each pair of runs in one call.

    A run of data is chosen by the key's hash, one of queries by theirs, so a block with any share of all rows is cut. Blocks are
    2^MOST_PREFIX for a substring at most, which is the size of the plan that is broadcast."""
    held, asked = (x.groupBy(by).agg(F.count(F.lit(1)).alias(n)) for x, n in ((data, "held"), (asking, "asked")))
    plan = common.table(held.join(asked, by).select(by, F.ceil(F.col("held") / rows).cast("int").alias("runs"), F.ceil(F.col("asked") / QUERY_ROWS).cast("int").alias("lots")), "plan")
    left = asking.join(F.broadcast(plan), by).withColumn("lot", F.pmod(F.xxhash64("query_id", "asked_id"), "lots").cast("int"))
    left = left.withColumn("run", F.explode(F.sequence(F.lit(0), F.col("runs") - 1))).drop("runs", "lots")
    right = data.join(F.broadcast(plan), by).withColumn("run", F.pmod(F.xxhash64("vec_id", "code"), "runs").cast("int"))
    right = right.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("runs", "lots")
    place = [by, "run", "lot"]
    return left.groupBy(*place).cogroup(right.groupBy(*place)).applyInArrow(search, schema)


def code_matrix(table: pa.Table) -> np.ndarray:
    """The substrings of each row; codes are stored as bytes."""
    return np.frombuffer(b"".join(table.column("code").to_pylist()), "<u4").reshape(table.num_rows, BITS // PART)


def part_radii(radius: np.ndarray, part: int) -> np.ndarray:
    """The radius that a substring is probed with: r is split into r + 1 - parts over all of them, so if every substring were farther, the codes would be too."""
    parts = BITS // PART
    return radius // parts - (part > radius % parts)


def nearest(df: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", column: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each row of `queries` the k rows of df at the smallest Euclidean distance that
    are found, other than those with the query's own key; all, if fewer. Equal distances go to the smaller key.

    Index: vectors become BITS signs of rotations that are learned on a bounded sample (SAMPLE rows, chosen by hash); every row is
    indexed under each of its BITS / PART substrings. Search: a bound of a query's k-th distance comes from the sample and from the
    query's own block; a table, learned on the sample's pairs, turns it into a Hamming radius that holds `recall` of such rows. The
    radius is split over the substrings by the pigeonhole principle: a substring's index blocks within its share are probed, there
    the substrings within it, and for each code within the whole radius the block of its vector is noted. The query then goes once to
    each noted block and measures, in double precision, every vector there whose code is within the radius. So every code within the
    radius is found; approximate are only the radii. Vectors are shuffled twice, codes once for each substring, and no pair of rows is
    written but k for a query and block.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, on either side, nor do null keys; vectors of
    unequal length are compared as if the shorter ended in zeros. Repeated rows of df are candidates of their own, ranked in any order
    among themselves. Repeated rows of `queries` are answered once; a key with several vectors is answered for each of them, with ranks
    from 1. Extra columns are dropped.
    """
    common.need(df, key, column)
    common.need(queries, key, column)
    spark = df.sparkSession
    data = common.table(vectors(df, key, column), "vectors")
    asked = vectors(queries, key, column).distinct()
    facts = data.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = facts["n"], max(facts["width"] or 1, asked.agg(F.max(F.size("v"))).first()[0] or 1)
    wanted = max(k + 2, min(SAMPLE, SAMPLE_VALUES // width))
    unit = F.pmod(F.xxhash64(F.lit("sample"), "vec_id", "v"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = data.filter(unit < min(1.0, 2 * wanted / max(n, 1))).withColumn("u", unit).orderBy("u", "vec_id").limit(wanted).select("vec_id", "v").collect()
    element = data.schema["v"].dataType
    as_matrix = lambda rows: matrix(pa.array([[float(c) for c in r] for r in rows] or [[0.0]], pa.list_(pa.float64())), width)
    known, known_ids = as_matrix([r["v"] for r in few]), np.array([r["vec_id"] for r in few] or [None], object)
    mean, projection = learn_rotation(known, BITS)
    known_codes = binary(known, mean, projection)
    edges, radii = learn_radii(known, known_codes, recall)
    prefix = int(np.clip(np.ceil(np.log2(max(n, 1) / VECTOR_ROWS)), LEAST_PREFIX, MOST_PREFIX))
    key_type, v_type = data.schema["vec_id"].dataType.simpleString(), element.simpleString()
    parts = BITS // PART

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                codes = binary(matrix(part.column("v"), width), mean, projection)
                raw = pa.array([r.tobytes() for r in codes.astype("<u4")], pa.binary())
                home = pa.array((codes[:, 0] >> (PART - prefix)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns, raw, home], names=[*part.schema.names, "code", "home"])

    coded = common.table(data.mapInArrow(encode, f"vec_id {key_type}, v {v_type}, code binary, home int"), "coded")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """bound: the distance of the k-th of the sample's other rows; least: the Hamming distance that k of them don't exceed."""
        for batch in encode(batches):
            x, codes = matrix(batch.column("v"), width), code_matrix(pa.table(batch))
            far, least = np.full(len(x), np.inf), np.full(len(x), BITS, np.int32)
            for i, own in enumerate(batch.column("query_id").to_pylist()):
                others = np.flatnonzero(known_ids != own)
                if len(few) and len(others) >= k:
                    far[i] = np.partition(distances(x[i], known[others]), k - 1)[k - 1]
                    least[i] = np.partition(apart(codes[i : i + 1], known_codes[others])[0], k - 1)[k - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far), pa.array(least)], names=[*batch.schema.names, "bound", "least"])

    keyed = asked.select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("asked_id"), "v")
    query_schema = f"query_id {key_type}, asked_id long, v {v_type}, code binary, home int"
    first = common.table(common.spread(keyed).mapInArrow(bound, f"{query_schema}, bound double, least int"), "asked")

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            x, codes, ids = matrix(right.column("v"), width), code_matrix(right), right.column("vec_id").to_numpy()
            place = np.unique(ids, return_inverse=True)[1]
            q, own, key, radius = matrix(left.column("v"), width), code_matrix(left), left.column("query_id").to_numpy(), left.column("radius").to_numpy()
            step = max(1, CELLS // len(x))
            for at in range(0, len(q), step):
                inside = (apart(own[at : at + step], codes) <= radius[at : at + step, None]) & (ids[None, :] != key[at : at + step, None])
                for i in np.flatnonzero(inside.any(axis=1)):
                    rows = np.flatnonzero(inside[i])
                    far = distances(q[at + i], x[rows])
                    if len(rows) > k:
                        close = far <= np.partition(far, k - 1)[k - 1]
                        rows, far = rows[close], far[close]
                    best = np.lexsort((place[rows], far))[:k]
                    asks = left.slice(at + i, 1).select(["query_id", "asked_id"]).take(pa.array(np.zeros(len(best), np.int64)))
                    out.append(asks.append_column("vec_id", right.column("vec_id").take(pa.array(rows[best]))).append_column("score", pa.array(far[best])))
        none = left.slice(0, 0).select(["query_id", "asked_id"]).append_column("vec_id", right.column("vec_id").slice(0, 0)).append_column("score", pa.array([], pa.float64()))
        return pa.concat_tables([*out, none])

    schema = f"query_id {key_type}, asked_id long, vec_id {key_type}, score double"
    rank = F.row_number().over(Window.partitionBy("query_id", "asked_id").orderBy("score", "vec_id")).alias("rank")
    near = meet(first.withColumn("radius", F.lit(BITS)), coded, "home", VECTOR_ROWS, rerank, schema)
    kth = near.select("query_id", "asked_id", "score", rank).filter(F.col("rank") == k).select("query_id", "asked_id", F.col("score").alias("closer"))
    closest = F.least(F.col("bound"), F.coalesce("closer", F.col("bound")))
    steps, sizes = F.array(*(F.lit(e) for e in edges)).cast("array<double>"), F.array(*(F.lit(r) for r in [*radii, BITS])).cast("array<int>")
    radius = F.greatest(F.element_at(sizes, F.size(F.filter(steps, lambda e: e < closest)) + 1), "least")
    sized = common.table(first.join(kth, ["query_id", "asked_id"], "left").withColumn("radius", radius).drop("bound", "closer", "least"), "sized")

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row under the block of each of its substrings: the substring's number and leading bits."""
        for batch in batches:
            codes = code_matrix(pa.table(batch))
            block = (np.arange(parts, dtype=np.int64) << MOST_PREFIX) + (codes >> (PART - prefix))
            at = np.repeat(np.arange(len(codes)), parts)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array(block.ravel().astype(np.int32))], names=[*batch.schema.names, "block"])

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query under every block whose leading bits are within its share of the radius."""
        leading = np.arange(1 << prefix, dtype=np.uint32)
        for batch in batches:
            codes, radius = code_matrix(pa.table(batch)), batch.column("radius").to_numpy()
            for at in range(0, len(codes), step := max(1, CELLS >> prefix)):
                for p in range(parts):
                    reach = part_radii(radius[at : at + step], p)
                    row, hit = np.nonzero(np.bitwise_count((codes[at : at + step, p] >> (PART - prefix))[:, None] ^ leading[None, :]).astype(np.int64) <= reach[:, None])
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at + row)).columns, pa.array(((p << MOST_PREFIX) + hit).astype(np.int32))], names=[*batch.schema.names, "block"])

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        """For each query of one substring's block the homes of the codes within its radius."""
        none = left.slice(0, 0).select(["query_id", "asked_id"]).append_column("home", pa.array([], pa.int32()))
        if not left.num_rows or not right.num_rows:
            return none
        p = right.column("block")[0].as_py() >> MOST_PREFIX
        codes, homes = code_matrix(right), right.column("home").to_numpy()
        order = np.lexsort((homes, codes[:, p]))
        codes, homes = codes[order], homes[order]
        values, begin = np.unique(codes[:, p], return_index=True)
        size = np.diff(np.concatenate([begin, [len(codes)]]))
        own, radius, out = code_matrix(left), left.column("radius").to_numpy(), []
        reach = part_radii(radius, p)
        for i in range(len(own)):
            hit = np.flatnonzero(np.bitwise_count(values ^ own[i, p]) <= reach[i])
            rows = np.repeat(begin[hit] - np.concatenate([[0], np.cumsum(size[hit])[:-1]]), size[hit]) + np.arange(size[hit].sum())
            found = np.unique(homes[rows[apart(own[i : i + 1], codes[rows])[0] <= radius[i]]])
            if len(found):
                out.append(left.slice(i, 1).select(["query_id", "asked_id"]).take(pa.array(np.zeros(len(found), np.int64))).append_column("home", pa.array(found.astype(np.int32))))
        return pa.concat_tables([*out, none])

    index = coded.select("vec_id", "code", "home").mapInArrow(substrings, f"vec_id {key_type}, code binary, home int, block int")
    probing = sized.select("query_id", "asked_id", "code", "radius").mapInArrow(probes, f"query_id {key_type}, asked_id long, code binary, radius int, block int")
    noted = meet(probing, index, "block", CODE_ROWS, probe, f"query_id {key_type}, asked_id long, home int").distinct()
    routed = common.table(sized.drop("home").join(noted, ["query_id", "asked_id"]), "routed")
    found = meet(routed, coded, "home", VECTOR_ROWS, rerank, schema)
    return found.select("query_id", "asked_id", "vec_id", "score", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship(spark)
    data = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(data, data.filter(F.col("vec_id") % 100 == 0))


QUERIES = {"op13_hamming_search": op13_hamming_search}
ORACLES: dict[str, str] = {}
