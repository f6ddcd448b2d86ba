"""Exact top-k by integer inner product, with pivot-table elimination.

Every row keeps its distances to many pivots (a pivot table, written once). For a
query the largest difference between its and a row's distance to a pivot bounds
their distance from below, hence their inner product from above. A task goes
through its rows in the order of that bound and stops where the bound falls below
the k-th best score found so far; the first such score comes from a bounded sample
of rows, so most rows are never multiplied.

The queries go round in blocks of bounded size, each against the whole pivot table
where it lies; only each task's k best rows of a query are shuffled.

Vectors that are null, hold null or non-finite components, have a null id or
another dimension than the most common one take no part. Rows that repeat are
candidates each; of a query id's rows the one with the least vector asks, and none
of them answers. Fewer candidates than k are all returned; an empty table gives no
row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumaprof.llm.common import written

#: Rows the pivots and the first thresholds come from, pivots, and queries of a block.
SAMPLE, PIVOTS, QUERY_BLOCK = 2048, 48, 8192
#: Rows multiplied at a time in the order of their bounds, and rows bounded at a time.
STEP, ROWS = 128, 4096
#: Squares and products stay exact in doubles below this.
EXACT = float(1 << 52)


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that take part, x in doubles."""
    whole = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"))
    whole = whole.filter("vec_id is not null and x is not null").filter(
        "not exists(x, c -> c is null or isnan(c) or abs(c) = double('infinity'))")
    common = whole.groupBy(F.size("x").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    return whole.filter(F.size("x") == (common["n"] if common else 0))


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def spread_out(points: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first choice of pivots."""
    chosen = [0]
    far = ((points - points[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (points ** 2).sum(1)[:, None] + (pivots ** 2).sum(1)[None, :] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(square, 0))


class Best:
    """The k best (score, id) of each query of a block, ties to the smaller id."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least = k, least
        self.scores = [np.empty(0)] * least.size
        self.ids = [np.empty(0, np.int64)] * least.size

    def offer(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least[query]
        if not good.any():
            return
        scores = np.concatenate([self.scores[query], scores[good]])
        ids = np.concatenate([self.ids[query], ids[good]])
        order = np.lexsort((ids, -scores))[:self.k]
        self.scores[query], self.ids[query] = scores[order], ids[order]
        if order.size == self.k:
            self.least[query] = max(self.least[query], scores[order[-1]])


def _product(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    if not rows.size or np.abs(rows).max() * max(1.0, np.abs(query).max()) * query.size < EXACT:
        return rows @ query
    # Beyond doubles: whole numbers of any size, cut to what a long holds.
    exact = [sum(int(a) * int(b) for a, b in zip(row, query)) for row in rows]
    return np.array([float(max(min(e, 2 ** 63 - 1025), -2 ** 63)) for e in exact])


def search(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, sample: int = SAMPLE,
           pivots: int = PIVOTS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products of floor(scale * x)."""
    rows = usable(vectors).select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("double")).alias("v"))
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    if picked.empty:
        return rows.selectExpr("vec_id as query_id", "1 as rank", "vec_id", "cast(0 as bigint) as score").limit(0)
    seeds, seed_ids = np.stack(picked["v"].to_numpy()), picked["vec_id"].to_numpy()
    exact = np.abs(seeds).max(initial=0) < 1e150
    points = spread_out(seeds, pivots) if exact else seeds[:1]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(matrix(batch.column("v"), batch.num_rows), points)
            lists = pa.ListArray.from_arrays(np.arange(0, far.size + 1, far.shape[1], dtype=np.int32), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["vec_id", "v", "far"])

    pivot_table = written(rows.mapInArrow(measure, "vec_id bigint, v array<double>, far array<double>"), "pivots")
    asked = pivot_table.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "far")).alias("q"))
    blocks = -(-pivot_table.filter(F.col("vec_id") % every == 0).count() // query_block)
    asked = written(asked.select("vec_id", "q.v", "q.far", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks))).alias("block")), "queries")
    found = [_one_block(pivot_table, asked.filter(F.col("block") == n), seeds, seed_ids, k) for n in range(max(1, blocks))]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _one_block(pivot_table: DataFrame, queries: DataFrame, seeds: np.ndarray, seed_ids: np.ndarray, k: int) -> DataFrame:
    """The k best rows of every task for each query of one block (at most a block's vectors are broadcast)."""
    block = queries.toPandas()
    ids = block["vec_id"].to_numpy(np.int64)
    vectors = np.stack(block["v"].to_numpy()) if len(block) else np.empty((0, seeds.shape[1]))
    far = np.stack(block["far"].to_numpy()) if len(block) else np.empty((0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full(ids.size, -np.inf)
        for q in range(ids.size):
            known = np.sort(_product(seeds[seed_ids != ids[q]], vectors[q]))
            if known.size >= k:
                least[q] = known[-k]
        best = Best(least, k)
        square = (vectors ** 2).sum(1)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                own = part.column("vec_id").to_numpy()
                rows, row_far = matrix(part.column("v"), part.num_rows), matrix(part.column("far"), part.num_rows)
                row_square = (rows ** 2).sum(1)
                for q in range(ids.size):
                    below = np.abs(row_far - far[q]).max(axis=1, initial=0)
                    # A little slack covers the rounding of the distances.
                    size = square[q] + row_square
                    bound = (size * (1 + 1e-9) + 1 - below ** 2 * (1 - 1e-9)) / 2
                    open_rows = np.flatnonzero((bound >= best.least[q]) & (own != ids[q]))
                    open_rows = open_rows[np.argsort(-bound[open_rows])]
                    for at in range(0, open_rows.size, STEP):
                        some = open_rows[at:at + STEP]
                        if bound[some[0]] < best.least[q]:
                            break
                        best.offer(q, _product(rows[some], vectors[q]), own[some])
        counts = [s.size for s in best.scores]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids, counts)), pa.array(np.concatenate([np.empty(0, np.int64), *best.ids])),
             pa.array(np.concatenate([np.empty(0), *best.scores]).astype(np.int64))], ["query_id", "vec_id", "score"])

    return pivot_table.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
