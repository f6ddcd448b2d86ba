"""Approximate nearest neighbours over learned partitions.

On a bounded sample the exact neighbour graph is drawn and cut into balanced parts
with few edges between them; a small softmax classifier learns the parts. It files
every row under its most probable part and sends a query to its most probable ones,
where all rows are compared by exact cosine. How many that are is measured: on
sample rows that the classifier has not seen, the fewest parts that hold the
wanted share of their neighbours in the sample (which lie farther off than those
in the whole table, so the share found there is higher). Parts (and their queries) that are
large are dealt out in blocks, so a vector that many rows share is many tasks.
Queries that find too few rows are asked again in all parts.

Vectors that are null, zero, hold null or non-finite components, have a null id or
another dimension than the most common one take no part. Rows that repeat are
candidates each; of a query id's rows the one with the least vector asks, and none
of them answers. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumaprof.llm.common import written
from lumaprof.llm.topk import matrix, usable

#: Rows the graph is drawn on, its neighbours, and the rows of it a part should have at least.
SAMPLE, NEIGHBOURS, PART_SAMPLE = 4096, 12, 48
#: Rows a part should have at least, and the share of neighbours that a query's parts should hold.
PART_ROWS, RECALL = 512, 0.95
#: Most rows and most queries of one task's block.
ROW_BLOCK, QUERY_BLOCK = 16_384, 8_192


def units(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares neither overflow nor vanish.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled ** 2).sum(axis=1, keepdims=True))


def neighbour_graph(points: np.ndarray, neighbours: int) -> list[np.ndarray]:
    """Each point's neighbours by cosine, in both directions."""
    count = len(points)
    near: list[set] = [set() for _ in range(count)]
    for start in range(0, count, 512):
        likeness = points[start:start + 512] @ points.T
        likeness[np.arange(len(likeness)), np.arange(start, start + len(likeness))] = -np.inf
        take = min(neighbours, count - 1)
        for row, best in enumerate(np.argpartition(-likeness, take - 1, axis=1)[:, :take] if take > 0 else []):
            for other in best.tolist():
                near[start + row].add(other)
                near[other].add(start + row)
    return [np.fromiter(s, np.int64, len(s)) for s in near]


def balanced_parts(graph: list[np.ndarray], parts: int, rounds: int = 12) -> np.ndarray:
    """A part for each node: grown along the graph to equal sizes, then refined by moves that cut fewer edges."""
    count = len(graph)
    most = -(-count // parts)
    part = np.full(count, -1)
    ahead: list[int] = []
    now, held = 0, 0
    for seed in range(count):
        if part[seed] >= 0:
            continue
        ahead.append(seed)
        at = len(ahead) - 1
        while at < len(ahead):
            node = ahead[at]
            at += 1
            if part[node] >= 0:
                continue
            if held == most:
                now, held = now + 1, 0
            part[node] = now
            held += 1
            ahead += [n for n in graph[node].tolist() if part[n] < 0]
        ahead.clear()
    sizes = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        moved = 0
        for node in range(count):
            votes = np.bincount(part[graph[node]], minlength=parts)
            gain = np.where(sizes < 1.1 * most, votes, -1)
            best = int(gain.argmax())
            if gain[best] > votes[part[node]] and sizes[part[node]] > 0.7 * most:
                sizes[part[node]] -= 1
                sizes[best] += 1
                part[node] = best
                moved += 1
        if not moved:
            break
    return part


def softmax_classifier(points: np.ndarray, part: np.ndarray, parts: int, rounds: int = 150) -> np.ndarray:
    """Weights (dimension + 1, parts) by accelerated gradient steps."""
    inputs = np.hstack([points, np.ones((len(points), 1))])
    aim = np.eye(parts)[part]
    weights = np.zeros((inputs.shape[1], parts))
    pace = np.zeros_like(weights)
    for _ in range(rounds):
        logits = 8 * inputs @ (weights + 0.9 * pace)
        logits -= logits.max(axis=1, keepdims=True)
        guess = np.exp(logits)
        guess /= guess.sum(axis=1, keepdims=True)
        pace = 0.9 * pace + 0.5 * (8 * inputs.T @ (aim - guess) / len(points)) - 1e-4 * weights
        weights += pace
    return weights


def logits_of(points: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return units(points) @ weights[:-1] + weights[-1]


def probes_for(queries: np.ndarray, points: np.ndarray, weights: np.ndarray, k: int, recall: float) -> int:
    """The fewest most probable parts that hold ``recall`` of the queries' k nearest points; all parts without queries."""
    parts = weights.shape[1]
    if not len(queries) or parts == 1:
        return parts
    likeness = queries @ points.T
    likeness[likeness > 1 - 1e-12] = -np.inf  # the query itself and its equals
    near = np.argsort(-likeness, axis=1)[:, :k]
    filed = logits_of(points, weights).argmax(axis=1)
    place = np.argsort(np.argsort(-logits_of(queries, weights), axis=1, kind="stable"), axis=1)
    places = np.take_along_axis(place, filed[near], axis=1)
    return next(p for p in range(1, parts + 1) if (places < p).mean() >= recall or p == parts)


def search(vectors: DataFrame, every: int = 50, k: int = 5, sample: int = SAMPLE, recall: float = RECALL,
           row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows found, by cosine in doubles."""
    rows = usable(vectors).filter("exists(x, c -> c <> 0)")
    total = rows.count()
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    if picked.empty:
        return rows.selectExpr("vec_id as query_id", "1 as rank", "vec_id", "cast(0 as double) as score").limit(0)
    points = units(np.stack(picked["x"].to_numpy()))
    seen = points[:max(1, 3 * len(points) // 4)]
    parts = int(max(1, min(len(seen) // PART_SAMPLE, total // PART_ROWS)))
    weights = softmax_classifier(seen, balanced_parts(neighbour_graph(seen, NEIGHBOURS), parts), parts)
    probes = probes_for(points[len(seen):], points, weights, k, recall)

    def file_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = logits_of(matrix(batch.column("x"), batch.num_rows), weights).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], ["vec_id", "x", "part"])

    salted = rows.mapInArrow(file_rows, "vec_id bigint, x array<double>, part int").withColumn(
        "salt", F.xxhash64("vec_id", F.monotonically_increasing_id()))
    index = written(salted, "index")
    asked = written(index.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x")), "queries")
    first = written(_compared(index, asked, weights, probes, k, row_block, query_block), "found")
    enough = min(k, max(0, total - 1))
    short = asked.join(first.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= enough)
                       .select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    if probes == parts or short.isEmpty():
        return first
    again = _compared(index, short, weights, parts, k, row_block, query_block)
    return first.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)


def _compared(index: DataFrame, asked: DataFrame, weights: np.ndarray, probes: int, k: int,
              row_block: int, query_block: int) -> DataFrame:
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logits = logits_of(matrix(batch.column("x"), batch.num_rows), weights)
            best = np.argsort(-logits, axis=1, kind="stable")[:, :probes].astype(np.int32)
            lists = pa.ListArray.from_arrays(np.arange(0, best.size + 1, best.shape[1], dtype=np.int32), pa.array(best.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["vec_id", "x", "parts"])

    routed = written(asked.mapInArrow(route, "vec_id bigint, x array<double>, parts array<int>"), "routed")
    sent = routed.select("vec_id", "x", F.explode("parts").alias("part"))
    # One row per part, of which there are at most sample / PART_SAMPLE.
    sizes = (index.groupBy("part").agg(F.ceil(F.count("*") / row_block).cast("int").alias("rb"))
             .join(sent.groupBy("part").agg(F.ceil(F.count("*") / query_block).cast("int").alias("qb")), "part"))
    sizes = F.broadcast(sizes)
    rows = index.join(sizes, "part").select(
        "part", F.pmod("salt", "rb").cast("int").alias("r"), F.explode(F.expr("sequence(0, qb - 1)")).alias("q"), "vec_id", "x",
        F.lit(False).alias("asks"))
    questions = sent.join(sizes, "part").select(
        "part", F.explode(F.expr("sequence(0, rb - 1)")).alias("r"), F.pmod(F.xxhash64("vec_id"), F.col("qb")).cast("int").alias("q"),
        "vec_id", "x", F.lit(True).alias("asks"))

    def compare(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        asks = block.column("asks").to_numpy()
        ids = block.column("vec_id").to_numpy()
        vectors = matrix(block.column("x").combine_chunks(), block.num_rows)
        query_ids, row_ids, row_vectors = ids[asks], ids[~asks], vectors[~asks]
        query_vectors = vectors[asks]
        row_units, query_units = units(row_vectors), units(query_vectors)
        norms = np.sqrt((row_vectors * row_vectors).sum(axis=1))
        found = []
        for start in range(0, query_ids.size, 256):
            likeness = query_units[start:start + 256] @ row_units.T
            for n, like in enumerate(likeness):
                own = start + n
                like[row_ids == query_ids[own]] = -np.inf
                count = int(np.isfinite(like).sum())
                if not count:
                    continue
                least = np.partition(like, like.size - min(k, count))[like.size - min(k, count)]
                near = np.flatnonzero(like >= least - 1e-9)
                near = near[np.isfinite(like[near])]
                query = query_vectors[own]
                score = (row_vectors[near] * query).sum(axis=1) / (norms[near] * np.sqrt((query * query).sum()))
                order = np.lexsort((row_ids[near], -score))[:k]
                found.append((np.full(order.size, query_ids[own]), row_ids[near][order], score[order]))
        columns = [np.concatenate([np.empty(0, t), *(f[n] for f in found)]) for n, t in enumerate((np.int64, np.int64, np.float64))]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))

    hits = rows.unionByName(questions).groupBy("part", "r", "q").applyInArrow(compare, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
