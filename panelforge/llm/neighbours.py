"""Nearest neighbours by a block matrix join of int8 tiles.

Vectors are quantised once to int8, each with a scale of its own and the norm of what the rounding left
over (and that once more to int8, for pairs that come close), and packed into blocks. Blocks of queries and of candidates are dealt to groups, and every two
groups meet in a tile: numbers of tiles grow with queries and with candidates. A tile multiplies in whole
numbers; the quantised products bound every true product from both sides (Cauchy and Schwarz on the
left-over parts). Pairs whose upper bound cannot reach a query's k-th best lower bound are pruned, first
within the tile, then over all of a query's tiles; the survivors fetch the original vectors, are
recomputed in double precision and merged by a heap a query. The result is exact: no pair is dropped
that could belong to the k nearest.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.llm.common import bounded_batches, map_arrow, staged

K, QUERY_EVERY = 20, 20
#: Components in a block at most (a byte each): 256 kB, so 4096 vectors of 64 components.
BLOCK_COMPONENTS = 1 << 18
#: Blocks of queries and of candidates in a group, about.
GROUP_QUERIES, GROUP_OTHERS = 4, 8
#: Queries multiplied at once.
STRIP = 256
#: Widens the bounds for the rounding of float arithmetic itself.
SLACK = 1e-5
#: Steps of the second int8 form in one of the first.
FINE = 254.0


def takes_part(vector: str) -> Column:
    """Not null, not empty, every component finite and one at least not zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(False)) & F.exists(v, lambda x: x != 0)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 forms of the rows of ``x`` and of what they leave over, and for each row its scale and the norms of the first and the second left-over, of the vector and of its two rounded forms."""
    wide = x.astype(np.float64)
    scale = np.abs(wide).max(1) / 127
    scale[scale == 0] = np.finfo(np.float64).tiny  # components too small to divide
    whole = lambda v, step: np.clip(np.rint(v / step[:, None]), -127, 127).astype(np.int8)
    q = whole(wide, scale)
    rest = wide - q * scale[:, None]
    fine = whole(rest, scale / FINE)
    last = rest - fine * (scale / FINE)[:, None]
    norms = [np.sqrt((v**2).sum(1)) * (1 + SLACK) for v in (rest, last, wide, wide - rest, wide - last)]
    return np.stack([q, fine]), np.stack([scale, *norms])


def packed(vectors: DataFrame) -> DataFrame:
    """(dim, block, n, data): quantised blocks of vectors of one length. ``vectors``: (row, id, v), row distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(dim: int) -> pa.RecordBatch:
            rows, ids, xs = zip(*held.pop(dim))
            q, facts = quantised(np.stack(xs))
            data = np.array([rows, ids], "<i8").tobytes() + facts.astype("<f8").tobytes() + q.tobytes()
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([rows[0]], pa.int64()), pa.array([len(rows)], pa.int32()), pa.array([data], pa.binary())], ["dim", "block", "n", "data"])

        for batch in batches:
            for row, i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                x = v.values.to_numpy(zero_copy_only=False)
                rows = held.setdefault(len(x), [])
                rows.append((row, i, x))
                if len(rows) * len(x) >= BLOCK_COMPONENTS:
                    yield out(len(x))
        for dim in list(held):
            yield out(dim)

    return vectors.select("row", "id", "v").mapInArrow(run, "dim int, block long, n int, data binary")


class Block:
    """A block in memory: row numbers, ids, int8 vectors, scales and norms."""

    def __init__(self, dim: int, n: int, data: bytes) -> None:
        self.rows, self.ids = np.frombuffer(data, "<i8", 2 * n).reshape(2, n)
        self.scale, self.left, self.last, self.norm, self.rounded, self.near = np.frombuffer(data, "<f8", 6 * n, 16 * n).reshape(6, n)
        self.q, self.fine = np.frombuffer(data, np.int8, 2 * n * dim, 64 * n).reshape(2, n, dim)

    def both(self, at: np.ndarray) -> np.ndarray:
        """The vectors at ``at`` as both int8 forms together give them."""
        return (self.q[at] + self.fine[at] / FINE) * self.scale[at, None]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, added up component by component in double precision."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d].astype(np.float64) * b[:, d]
    return total


def tile(queries: Block, others: Block, floor: np.ndarray, k: int) -> list[tuple[np.ndarray, ...]]:
    """(query place, candidate row, lower, upper bound) of the pairs that can be among a query's k nearest.

    ``floor``: each query's k-th best lower bound of one block so far; raised in place.
    """
    # int8 products up to 2^24 are whole numbers in float32
    exact = np.float32 if queries.q.shape[1] * 127 * 127 < 2**24 else np.float64
    right, out = others.q.astype(exact).T, []
    for at in range(0, len(queries.ids), STRIP):
        s = slice(at, at + STRIP)
        near = (queries.q[s].astype(exact) @ right).astype(np.float64) * queries.scale[s, None] * others.scale[None, :]
        bound = queries.left[s, None] * others.rounded[None, :] + queries.norm[s, None] * others.left[None, :]
        bound += SLACK * np.abs(near) + 1e-300
        near[queries.ids[s, None] == others.ids[None, :]] = -np.inf
        low, high = near - bound, near + bound
        if low.shape[1] > k:
            floor[s] = np.maximum(floor[s], np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
        i, j = np.nonzero((high >= floor[s, None]) & (high > -np.inf))
        for a in range(0, len(i), 1 << 16):
            x, y = i[a : a + (1 << 16)] + at, j[a : a + (1 << 16)]
            # the second forms narrow the bounds of these pairs some 250 times
            close = products(queries.both(x), others.both(y))
            bound = queries.last[x] * others.near[y] + queries.norm[x] * others.last[y] + 1e-12 * np.abs(close) + 1e-300
            out.append((x, others.rows[y], close - bound, close + bound))
    return [tuple(survivors(out, k))] if out else []


def survivors(parts: list[tuple[np.ndarray, ...]], k: int) -> list[np.ndarray]:
    """The pairs of ``tile`` whose upper bound reaches the k-th best lower bound of their query over all of them."""
    q, row, low, high = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((-low, q))
    q, row, low, high = q[order], row[order], low[order], high[order]
    first = np.searchsorted(q, q)  # of the pair's query
    kth = first + k - 1
    enough = (kth < len(q)) & (q[np.minimum(kth, len(q) - 1)] == q)
    keep = ~enough | (high >= low[np.minimum(kth, len(q) - 1)])
    return [q[keep], row[keep], low[keep], high[keep]]


def bounded_pairs(asked: DataFrame, held: DataFrame, groups: int, stripes: int, k: int) -> DataFrame:
    """(q, c, low, high): row numbers of queries and candidates that can be among the k nearest, with bounds."""
    deal = lambda df, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64("block"), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
    left = deal(asked, "qs", groups, "cs", stripes)
    right = deal(held, "cs", stripes, "qs", groups).select("dim", "qs", "cs", F.col("n").alias("on"), F.col("data").alias("odata"))
    pairs = left.join(right, ["dim", "qs", "cs"]).select("dim", "cs", "block", "n", "data", "on", "odata")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block, floor, parts = None, None, None, []

        def found() -> pa.RecordBatch:
            q, row, low, high = survivors(parts, k)
            return pa.RecordBatch.from_arrays([pa.array(block.rows[q]), pa.array(row), pa.array(low), pa.array(high)], ["q", "c", "low", "high"])

        for batch in batches:
            for r in range(batch.num_rows):
                dim, cs, name, n, data, on, odata = (c[r].as_py() for c in batch.columns)
                if (name, cs) != own:
                    if parts:
                        yield found()
                    own, block, parts = (name, cs), Block(dim, n, data), []
                    floor = np.full(n, -np.inf)
                parts += tile(block, Block(dim, on, odata), floor, k)
                if sum(len(p[0]) for p in parts) > 1 << 20:
                    parts = [tuple(survivors(parts, k))]
        if parts:
            yield found()

    return pairs.mapInArrow(run, "q long, c long, low double, high double")


def scored(pairs: DataFrame) -> DataFrame:
    """(query_id, vec_id, score): exact products. ``pairs``: (query_id, vec_id, qv, cv)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        q, c = batch.column(2), batch.column(3)
        sizes = np.diff(q.offsets.to_numpy())
        score = np.zeros(batch.num_rows)
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            x, y = (col.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) for col in (q, c))
            score[at] = products(x, y)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["query_id", "vec_id", "score"])

    return map_arrow(pairs, run, "query_id long, vec_id long, score double")


def merged(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query, held on a heap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, heap = None, []

        def best(ended: list[tuple[int, list]]) -> pa.RecordBatch:
            rows = [(q, n + 1, -o, v) for q, h in ended for n, (v, o) in enumerate(sorted(h, reverse=True))]
            cols = list(zip(*rows)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], ["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            ended = []
            for q, o, v in zip(*(c.to_pylist() for c in batch.columns)):
                if q != own:
                    ended.append((own, heap))
                    own, heap = q, []
                if len(heap) < k:
                    heapq.heappush(heap, (v, -o))
                elif (v, -o) > heap[0]:
                    heapq.heapreplace(heap, (v, -o))
            yield best(ended)
        yield best([(own, heap)])

    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(run, "query_id long, rank int, vec_id long, score double")


def nearest(queries: DataFrame, vectors: DataFrame, k: int = K, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by inner product, ties to the smaller id; all if fewer.

    ``queries`` are rows of the same shape as ``vectors``; a candidate with the query's own id is not
    its neighbour. Vectors that are null, empty, zero or hold null or non-finite components, and rows
    without an id, take no part; vectors meet only those of their own length, however long. Ids held by
    several rows are candidates each; their queries are searched once for each vector and merged by id.
    Empty tables give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)

    def fit(df: DataFrame, label: str) -> DataFrame:
        rows = df.where(takes_part(vector) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
        return staged(rows.withColumn("row", F.monotonically_increasing_id()), label)

    # of equal vectors, which tie with every query, only those of the k + 1 smallest ids can be among the k nearest
    same = F.dense_rank().over(W.partitionBy(F.size(vector), vector).orderBy(F.col(id_col).cast("long")))
    able = vectors.select(id_col, vector).where(takes_part(vector) & F.col(id_col).isNotNull())
    asked, held = fit(queries, "queries"), fit(able.withColumn("_same", same).where(F.col("_same") <= k + 1), "vectors")
    full = lambda df, c: df.repartition(max(1, c // BLOCK_COMPONENTS), "row")
    count = lambda df: df.agg(F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0)).alias("c")).first()["c"]
    nq, nc = count(asked), count(held)
    groups, stripes = (1 + n // (BLOCK_COMPONENTS * g) for n, g in ((nq, GROUP_QUERIES), (nc, GROUP_OTHERS)))
    pairs = staged(bounded_pairs(staged(packed(full(asked, nq)), "query-blocks"), staged(packed(full(held, nc)), "blocks"), groups, stripes, k), "pairs")
    if stripes > 1:
        best = pairs.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("low")))).where(F.col("n") <= k)
        best = best.groupBy("q").agg(F.min("low").alias("floor"), F.count("*").alias("n"))
        pairs = pairs.join(best, "q").where((F.col("n") < k) | (F.col("high") >= F.col("floor"))).select("q", "c")
    pairs = pairs.join(asked.select(F.col("row").alias("q"), F.col("id").alias("query_id"), F.col("v").alias("qv")), "q")
    pairs = pairs.join(held.select(F.col("row").alias("c"), F.col("id").alias("vec_id"), F.col("v").alias("cv")), "c")
    return merged(scored(pairs.select("query_id", "vec_id", "qv", "cv")), k)


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors.where(F.col("vec_id") % QUERY_EVERY == 0), vectors)


OP7_SQL = """
WITH ok AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM ok q JOIN ok c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
