"""Exact top-k search by inner product: a Voronoi kNN join with bounds from cell summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm import common

SCALE = 256
#: Pivots are this many vectors at most, and about one for ROWS_A_PIVOT vectors; they come from a sample of PIVOT_SAMPLE rows for each, as expected.
MAX_PIVOTS = 16_384
ROWS_A_PIVOT = 50
PIVOT_SAMPLE = 4
#: A row looks for its pivot near one of a FANOUT-th of them.
FANOUT = 64
#: Data rows and queries that a local search holds: a block is cells that lie near one another, together about so many rows; larger
#: cells, and blocks with more queries, are split.
BLOCK_ROWS = 20_000
QUERY_ROWS = 20_000
#: Scores are exact in double precision while the products stay below 2^53, else integer arithmetic is used.
EXACT = float(1 << 53)
QUERIES_AT_ONCE = 256
#: Queries that need this share of a block's cells get the whole block at once: one product instead of many small ones.
DENSE = 0.25
NO_SCORE = np.iinfo(np.int64).min


def vectors(df: DataFrame, key: str, column: str, scale: int) -> DataFrame:
    """vec_id, v: whole-number components floor(scale * x), for vectors without null or non-finite components and with a key."""
    x = F.col(column)
    ok = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.filter(ok & F.col(key).isNotNull()).select(F.col(key).alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v")).filter(F.size("v") > 0)


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of doubles, shorter vectors ended by zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class Cells:
    """Pivots, and what is known of the vectors nearest to each: how far the farthest is, and the k + 1 keys that are nearest."""

    def __init__(self, pivots: np.ndarray):
        self.pivots, self.norms = pivots, np.sqrt((pivots**2).sum(axis=1))
        coarse = max(1, len(pivots) // FANOUT)
        near = self._nearest(pivots, np.arange(coarse))
        self.members = [np.flatnonzero(near == c) for c in range(coarse)]

    def _nearest(self, x: np.ndarray, among: np.ndarray) -> np.ndarray:
        return (self.norms[among] ** 2 - 2 * x @ self.pivots[among].T).argmin(axis=1)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """A pivot for each row, the nearest of those around the nearest coarse one, the distance from it, the row's length and its
        angle to the pivot (pi where one is zero)."""
        coarse, cell = self._nearest(x, np.arange(len(self.members))), np.zeros(len(x), np.int64)
        for c in np.unique(coarse):
            rows = np.flatnonzero(coarse == c)
            cell[rows] = self.members[c][self._nearest(x[rows], self.members[c])]
        length = np.sqrt((x**2).sum(axis=1))
        return cell, np.sqrt(((x - self.pivots[cell]) ** 2).sum(axis=1)), length, angles((x * self.pivots[cell]).sum(axis=1), length * self.norms[cell])

    def summarise(self, sizes: dict[int, tuple], nearest: list[tuple], block_rows: int) -> None:
        """sizes: each filled cell's rows, largest distance, largest length and widest angle. nearest: (cell, key, distance), k + 1 keys
        of each cell at most. Cells around one coarse pivot, one after another, make blocks of about block_rows rows."""
        self.filled = np.array(sorted(sizes), np.int64)
        self.radius, self.longest, self.widest = (np.array([sizes[c][i] for c in self.filled.tolist()], np.float64) for i in (1, 2, 3))
        near = np.zeros(len(self.pivots), np.int64)
        for i, m in enumerate(self.members):
            near[m] = i
        order = np.lexsort((self.filled, near[self.filled]))
        rows = np.array([sizes[c][0] for c in self.filled[order].tolist()], np.int64)
        self.block = np.zeros(len(self.filled), np.int64)
        self.block[order] = (np.cumsum(rows) - 1) // block_rows
        number = {c: i for i, c in enumerate(self.filled.tolist())}
        nearest = sorted(nearest, key=lambda e: e[0])
        self.entry_cell = np.array([number[e[0]] for e in nearest], np.int64)
        self.entry_far = np.array([e[2] for e in nearest], np.float64)
        self.entry_key = [e[1] for e in nearest]
        self.first = np.searchsorted(self.entry_cell, np.arange(len(self.filled) + 1))

    def entries_of(self, cells: np.ndarray) -> np.ndarray:
        sizes = self.first[cells + 1] - self.first[cells]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return np.arange(ends[-1]) + np.repeat(self.first[cells] - ends[:-1], sizes)

    def of_group(self, pivot: int, reach: float, k: int) -> np.ndarray:
        """Cells (as numbers of the filled ones) that can matter to queries within `reach` of a pivot. For such a query q and a vector
        x of a cell with pivot c: |q.x - p.c| <= reach |c| + (|p| + reach) d(x, c). A query's own key is one of the k + 1 that the
        bound rests on at most."""
        to = self.pivots[self.filled] @ self.pivots[pivot]
        norm, others = self.norms[pivot] + reach, self.norms[self.filled]
        slack = 1e-9 * (np.abs(to) + reach * others + norm * self.radius) + 1e-6  # keeps rounding on the safe side
        low = to[self.entry_cell] - reach * others[self.entry_cell] - norm * self.entry_far - slack[self.entry_cell]
        bound, keys = -np.inf, set()
        for i in np.argsort(-low):
            keys.add(self.entry_key[i])
            if len(keys) > k:
                bound = low[i]
                break
        return np.flatnonzero(to + reach * others + norm * self.radius + slack >= bound)

    def of_query(self, q: np.ndarray, own, cells: np.ndarray, entries: np.ndarray, k: int, reached: float = -np.inf) -> np.ndarray:
        """Of `cells`, with their entries, those that can hold one of the k best vectors of the query itself, of which all k are known
        to score `reached` at least."""
        to, norm = self.pivots[self.filled[cells]] @ q, np.sqrt((q**2).sum())
        slack = 1e-9 * (np.abs(to) + norm * self.radius[cells]) + 1e-6
        at = np.searchsorted(cells, self.entry_cell[entries])
        low = to[at] - norm * self.entry_far[entries] - slack[at]
        bound, keys = -np.inf, set()
        first = np.argpartition(-low, min(4 * k, len(low) - 1))[: 4 * k] if len(low) > 4 * k else np.arange(len(low))
        for i in [*first[np.argsort(-low[first])], *([] if len(first) == len(low) else np.argsort(-low))]:  # the second only if keys repeat
            if (key := self.entry_key[entries[i]]) != own:
                keys.add(key)
                if len(keys) == k:
                    bound = low[i]
                    break
        apart = np.maximum(angles(to, norm * self.norms[self.filled[cells]]) - self.widest[cells], 0.0)
        unsure = self.norms[self.filled[cells]] == 0
        turned = norm * self.longest[cells] * np.where(unsure, 1.0, np.cos(apart))
        high = np.minimum(to + norm * self.radius[cells], np.where(turned > 0, turned, np.inf))
        return cells[high + slack + 1e-9 * norm * self.longest[cells] >= max(bound, reached)]


def angles(product: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Angles from inner products and products of lengths; pi where a length is zero."""
    return np.where(lengths > 0, np.arccos(np.clip(product / np.where(lengths > 0, lengths, 1.0), -1.0, 1.0)), np.pi)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows."""
    if not q.size or not x.size or np.abs(q).max() * np.abs(x).max() * q.shape[1] < EXACT:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k highest scores, ties to smaller ids; columns with the row's own id are left out."""
    scores = np.where(ids[None, :] == own[:, None], NO_SCORE, scores)
    least = np.partition(scores, -k, axis=1)[:, -k][:, None] if scores.shape[1] > k else np.full((len(scores), 1), NO_SCORE)
    row, column = np.nonzero((scores >= least) & (scores > NO_SCORE))
    _, place = np.unique(ids, return_inverse=True)
    order = np.lexsort((place[column], -scores[row, column], row))
    row, column = row[order], column[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], column[rank < k]


def top_k(df: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each row of `queries` the k rows of df with the highest integer inner product,
    other than those with the query's own key; all, if fewer. Equal scores go to the smaller key.

    Components become floor(scale * x), which ends at the limits of 64 bits; scores beyond those limits aren't defined. Null or empty
    vectors and vectors with null or non-finite components take no part, on either side, nor do null keys; vectors of unequal length
    are compared as if the shorter ended in zeros. Repeated rows of df are candidates of their own, ranked in any order among
    themselves. Repeated rows of `queries` are answered once; a key with several vectors is answered for each of them, with ranks
    from 1. Extra columns are dropped.

    Data and queries are grouped by pivots. A group of queries gets its cells from the summaries alone (Cells.of_group()): those whose
    upper bound of scores reaches the (k + 1)-th best lower bound; each query keeps those of them that its own bounds leave, by
    distance from the pivot and by angle and length, once the best of its own cell are known. Neighbouring cells make blocks; a query goes once to each block that has some of
    its cells, with their list, so at most queries x blocks rows are written. Blocks are searched by matrix products, cell by cell
    unless most cells are asked for, and their results are merged. Pivots and summaries are all that the driver sees: MAX_PIVOTS
    rows, with k + 1 keys each. Where vectors are spread evenly, bounds leave nearly all cells, and the search is one of all pairs.
    """
    spark = df.sparkSession
    data = common.table(vectors(df, key, column, scale), "vectors")
    asked = common.table(vectors(queries, key, column, scale).distinct(), "asked")
    facts = data.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    width = max(facts["width"] or 1, asked.agg(F.max(F.size("v"))).first()[0] or 1)
    unit = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    wanted = max(1, min(MAX_PIVOTS, facts["n"] // ROWS_A_PIVOT))
    few = data.filter(unit < min(1.0, PIVOT_SAMPLE * (wanted + 16) / max(facts["n"], 1))).groupBy("v").agg(F.min("vec_id").alias("vec_id"))
    picked = [r["v"] for r in few.orderBy(F.xxhash64(F.lit("pivot"), "vec_id"), "vec_id").limit(wanted).collect()]
    cells = Cells(matrix(pa.array(picked or [[0]], pa.list_(pa.int64())), width))
    key_type = data.schema["vec_id"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                cell, *facts = cells.place(matrix(part.column("v"), width))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), *map(pa.array, facts)], names=["vec_id", "v", "cell", "far", "length", "angle"])

    assigned = f"vec_id {key_type}, v array<long>, cell int, far double, length double, angle double"
    placed, groups = (common.table(x.mapInArrow(assign, assigned), name) for x, name in ((data, "cells"), (asked, "groups")))
    closest = placed.groupBy("cell", "vec_id").agg(F.min("far").alias("far"))
    nearest = closest.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("far", "vec_id"))).filter(F.col("r") <= k + 1).collect()
    summary = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far"), F.max("length").alias("length"), F.max("angle").alias("angle"))
    sizes = {r["cell"]: (r["n"], r["far"], r["length"], r["angle"]) for r in summary.collect()}
    cells.summarise(sizes, [(r["cell"], r["vec_id"], r["far"]) for r in nearest], BLOCK_ROWS)
    reach = {r["cell"]: (r["far"], r["n"]) for r in groups.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()}

    block_of = F.broadcast(spark.createDataFrame(list(zip(cells.filled.tolist(), cells.block.tolist(), strict=True)), "cell int, block int"))
    held: dict[int, int] = {}
    for c, b in zip(cells.filled.tolist(), cells.block.tolist(), strict=True):
        held[b] = held.get(b, 0) + sizes[c][0]
    place = ["block", "run", "part"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("cell")
        ids, x, out = right.column("vec_id").to_numpy(), matrix(right.column("v"), width), []
        here, first = np.unique(right.column("cell").to_numpy(), return_index=True)
        ends = np.append(first, len(ids))
        for at in range(0, left.num_rows if len(ids) else 0, QUERIES_AT_ONCE):
            own = left.slice(at, QUERIES_AT_ONCE)
            q, keys = matrix(own.column("v"), width), own.column("query_id").to_numpy()
            lists = own.column("wanted").combine_chunks()
            row, cell = np.repeat(np.arange(own.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
            if len(cell) >= DENSE * own.num_rows * len(here):
                scores = products(q, x)
                row, found = best(scores, ids, keys, k)
                score = scores[row, found]
            else:
                some = []
                order = np.argsort(cell, kind="stable")
                row, cell = row[order], cell[order]
                for c in np.intersect1d(cell, here):
                    asks = row[np.searchsorted(cell, c) : np.searchsorted(cell, c, side="right")]
                    a, b = ends[np.searchsorted(here, c) : np.searchsorted(here, c) + 2]
                    scores = products(q[asks], x[a:b])
                    r, f = best(scores, ids[a:b], keys[asks], k)
                    some.append((asks[r], a + f, scores[r, f]))
                row, found, score = (np.concatenate([s[i] for s in some]) if some else np.zeros(0, np.int64) for i in range(3))
                order = np.lexsort((np.unique(ids, return_inverse=True)[1][found], -score, row))
                row, found, score = row[order], found[order], score[order]
                kept = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, found, score = row[kept], found[kept], score[kept]
            taken = own.select(["query_id", "asked"]).take(pa.array(row))
            out.append(taken.append_column("vec_id", right.column("vec_id").take(pa.array(found))).append_column("score", pa.array(score)))
        none = left.slice(0, 0).select(["query_id", "asked"])
        return pa.concat_tables(out) if out else none.append_column("vec_id", right.column("vec_id").slice(0, 0)).append_column("score", pa.array([], pa.int64()))

    def answers(routed: DataFrame) -> DataFrame:
        """The best of each query's wanted cells, from rows of query_id, v, block and wanted."""
        asking = {r["block"]: r["n"] for r in routed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
        plan = F.broadcast(spark.createDataFrame([(b, -(-held[b] // (2 * BLOCK_ROWS)), -(-n // QUERY_ROWS)) for b, n in asking.items()], "block int, runs int, parts int"))
        left = routed.withColumn("asked", F.xxhash64("v")).join(plan, "block").withColumn("part", F.pmod(F.xxhash64("query_id", "v"), "parts").cast("int"))
        left = left.withColumn("run", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)))
        right = placed.select("vec_id", "v", "cell").join(block_of, "cell").join(plan, "block").withColumn("run", F.pmod(F.xxhash64("vec_id"), "runs").cast("int"))
        right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        pairs = left.select("query_id", "asked", "v", "wanted", *place).groupBy(*place).cogroup(right.select("vec_id", "v", "cell", *place).groupBy(*place))
        found = pairs.applyInArrow(search, f"query_id {key_type}, asked long, vec_id {key_type}, score long")
        rank = F.row_number().over(Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own, entries = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows, blocks, lists = [], [], []
                for i, (q, key, cell, score) in enumerate(zip(matrix(part.column("v"), width), *(part.column(c).to_pylist() for c in ("vec_id", "cell", "reached")), strict=True)):
                    if cell != group:
                        group, own = cell, cells.of_group(cell, reach[cell][0], k)
                        entries = cells.entries_of(own)
                    known = -np.inf if score is None else score - 1e-9 * abs(score)
                    found = cells.of_query(q, key, own, entries, k, known)
                    found = found[np.argsort(cells.block[found], kind="stable")]
                    block, first = np.unique(cells.block[found], return_index=True)
                    rows += [i] * len(block)
                    blocks += block.tolist()
                    lists += np.split(cells.filled[found].astype(np.int32), first[1:]) if len(block) else []
                chosen = part.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([chosen.column("vec_id"), chosen.column("v"), pa.array(blocks, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], names=["query_id", "v", "block", "wanted"])

    beside = groups.join(block_of, "cell").select(F.col("vec_id").alias("query_id"), "v", "block", F.array("cell").alias("wanted"))
    reached = answers(common.table(beside, "beside")).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "asked", F.col("score").cast("double").alias("reached"))
    salts = F.broadcast(spark.createDataFrame([(c, -(-n // QUERY_ROWS)) for c, (_, n) in reach.items()], "cell int, salts int"))
    lined = groups.withColumn("asked", F.xxhash64("v")).join(reached, ["vec_id", "asked"], "left").join(salts, "cell").withColumn("salt", F.pmod(F.xxhash64("vec_id", "v"), "salts"))
    lined = lined.repartition("cell", "salt").sortWithinPartitions("cell").select("vec_id", "v", "cell", "reached")
    routed = common.table(lined.mapInArrow(route, f"query_id {key_type}, v array<long>, block int, wanted array<int>"), "routed")
    return answers(routed).select("query_id", "rank", "vec_id", "score")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship(spark)
    data = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(data, data.filter(F.col("vec_id") % 50 == 0))


ORACLES = {
    "op9_exact_top_k": """
WITH parts AS (
  SELECT vec_id, UNNEST(embedding)::DOUBLE AS x, UNNEST(range(len(embedding))) AS i FROM embeddings
), whole AS (
  SELECT vec_id, i, CAST(floor(256 * x) AS BIGINT) AS c FROM parts
), scores AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(sum(q.c * d.c) AS BIGINT) AS score
  FROM whole q JOIN whole d ON q.i = d.i AND q.vec_id <> d.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, d.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
}
QUERIES = {"op9_exact_top_k": op9_exact_top_k}
