"""Hard-negative mining by threshold joins in the manner of L2AP.

A threshold join finds all pairs of an anchor and a row whose inner product reaches
the anchor's threshold. Inside of a task the rows of a block are an inverted index
over the dimensions, in one order for all: a row is left out of the index in the
last dimensions, as many as have a norm too small to reach any threshold of the
anchors at hand by themselves. Scores are accumulated along the index, a group of
dimensions at a time; after each group, pairs that cannot reach the threshold any
more even if what remains of both vectors were parallel are given up, and rows
without an open pair leave the index. Pairs that are still open at the end get
their exact score. A threshold rises inside a task as soon as the task alone fills a window.

1. Positives: rows meet only the anchors of their own label. Thresholds start at what
   a bounded sample of rows promises and are lowered, in the end to none, until
   every anchor has ``positives`` rows.
2. Negatives: the window of a positive is ``[low * score, score]``. Thresholds start in
   its upper part and are lowered to its lower end for the windows that are not full.

Rows and anchors are dealt out in blocks of bounded size, hot labels too; a task
returns at most a window's rows for each anchor and window. Norms, blocks and
thresholds cover all rows; only the first thresholds come from a sample, and a
wrong guess costs another round, not a row.

Rows with a null id, label or vector, null or non-finite components, or another
dimension than the most common one take no part. Repeated rows are candidates each;
of an anchor id's rows the one with the least (vector, label) asks, and none of them
answers. A window without rows gives none; an empty table gives no row. Scores must
stay below 2**53. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaprof.llm.common import join_by_share, written
from lumaprof.llm.topk import matrix

#: Most rows and most anchors of a task's block, anchors and dimensions taken at a time.
ROW_BLOCK, ANCHOR_BLOCK, TILE, GROUP = 16_384, 4_096, 256, 16
#: Rows of an index, after which thresholds rise.
CHUNK = 4096
#: Rows that the first thresholds are guessed from.
SAMPLE = 4096
#: Which part of a window from its upper end is searched first.
UPPER = 0.25


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, x) of the rows that take part, x in doubles."""
    whole = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("int").alias("label"),
                           F.col("embedding").cast("array<double>").alias("x"))
    whole = whole.filter("vec_id is not null and label is not null and x is not null").filter(
        "not exists(x, c -> c is null or isnan(c) or abs(c) = double('infinity'))")
    common = whole.groupBy(F.size("x").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    return whole.filter(F.size("x") == (common["n"] if common else 0))


def rest_norms(vectors: np.ndarray) -> np.ndarray:
    """Norm of what follows each multiple of ``GROUP`` dimensions, with a little slack for rounding; the last column is zero."""
    starts = np.arange(0, vectors.shape[1], GROUP)
    squares = np.add.reduceat(vectors ** 2, starts, axis=1)
    rest = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.hstack([rest, np.zeros((len(vectors), 1))])) * (1 + 1e-12)


class Index:
    """Inverted index of a block's rows: for each group of dimensions the rows that are listed there."""

    def __init__(self, vectors: np.ndarray, longest: float, threshold: float):
        """Rows omit the last groups of dimensions while those cannot reach ``threshold`` with anchors up to ``longest``."""
        self.vectors, self.rest = vectors, rest_norms(vectors)
        # The rest only shrinks, so this counts the leading groups from which on it still matters.
        self.listed = (self.rest * longest >= threshold).sum(axis=1)

    def pairs(self, anchors: np.ndarray, anchor_rest: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, row) of all pairs that may reach the anchor's threshold ``least``."""
        groups = self.rest.shape[1] - 1
        rows = np.flatnonzero(self.listed > 0)
        score = np.zeros((len(anchors), rows.size))
        for g in range(groups):
            if not rows.size:
                break
            dims = slice(g * GROUP, (g + 1) * GROUP)
            here = self.listed[rows] > g
            if here.all():
                score += anchors[:, dims] @ self.vectors[rows, dims].T
            elif here.any():
                score[:, here] += anchors[:, dims] @ self.vectors[rows[here], dims].T
            # A row that left the index earlier is bounded by the rest at the point where it left.
            at = np.minimum(self.listed[rows], g + 1)
            bound = score + anchor_rest[:, at] * self.rest[rows, at][None, :]
            alive = (bound >= least[:, None]).any(axis=0)
            rows, score = rows[alive], score[:, alive]
        if not rows.size:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(self.listed[rows], groups)
        open_pairs = score + anchor_rest[:, at] * self.rest[rows, at][None, :] >= least[:, None]
        anchor, row = np.nonzero(open_pairs)
        return anchor, rows[row]


def _blocks(rows: DataFrame, anchors: DataFrame, keys: list[str], row_block: int, anchor_block: int) -> DataFrame:
    """Rows and anchors side by side in blocks: every row meets every anchor of its key in exactly one block."""
    def parts(side: DataFrame, most: int, name: str) -> DataFrame:
        counted = side.groupBy(*keys) if keys else side.groupBy(F.lit(0).alias("_all"))
        return counted.agg(F.ceil(F.count("*") / most).cast("int").alias(name)).select(*keys, name)

    row_parts, anchor_parts = parts(rows, row_block, "rb"), parts(anchors, anchor_block, "ab")
    if keys:
        # A key that many rows share meets its block counts in a broadcast, not in a shuffle.
        (key,) = keys
        sizes = written(row_parts.join(anchor_parts, key).join(rows.groupBy(key).agg(F.count("*").alias("n")), key), "sizes")
        with_rows, with_anchors = (join_by_share(side, sizes, key, "n") for side in (rows, anchors))
    else:  # two numbers
        rb, ab = ((p.first() or [0])[0] for p in (row_parts, anchor_parts))
        with_rows, with_anchors = (s.withColumn("rb", F.lit(rb)).withColumn("ab", F.lit(ab)).filter(F.lit(rb * ab > 0)) for s in (rows, anchors))
    sided = with_rows.select(
        *(F.col(c).alias(f"_{c}") for c in keys), F.pmod("salt", "rb").cast("int").alias("r"), F.explode(F.expr("sequence(0, ab - 1)")).alias("a"),
        "vec_id", "label", "v", F.lit(None).cast("array<double>").alias("tops"), F.lit(None).cast("array<double>").alias("leasts"))
    asking = with_anchors.select(
        *(F.col(c).alias(f"_{c}") for c in keys), F.explode(F.expr("sequence(0, rb - 1)")).alias("r"), F.pmod(F.xxhash64("vec_id"), F.col("ab")).cast("int").alias("a"),
        "vec_id", "label", "v", "tops", "leasts")
    return sided.unionByName(asking).groupBy(*(f"_{c}" for c in keys), "r", "a")


FOUND = "anchor_id bigint, top double, found_id bigint, score bigint"


class Kept:
    """The k first rows of each window [least, top] of one anchor, as far as a task has seen."""

    def __init__(self, tops: list[float], leasts: list[float], k: int):
        self.k, self.tops, self.leasts = k, tops, list(leasts)
        self.scores = [np.empty(0)] * len(tops)
        self.ids = [np.empty(0, np.int64)] * len(tops)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        for w, top in enumerate(self.tops):
            inside = (scores <= top) & (scores >= self.leasts[w])
            if inside.any():
                all_scores, all_ids = np.concatenate([self.scores[w], scores[inside]]), np.concatenate([self.ids[w], ids[inside]])
                best = np.lexsort((all_ids, -all_scores))[:self.k]
                self.scores[w], self.ids[w] = all_scores[best], all_ids[best]
                if best.size == self.k:
                    self.leasts[w] = max(self.leasts[w], float(self.scores[w][-1]))


def _joined(k: int, same_label: bool) -> Callable[[pa.Table], pa.Table]:
    """The threshold join of one block: per anchor and window its k first rows there."""
    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        asks = np.array(block.column("tops").is_valid())
        ids, labels = (block.column(c).to_numpy() for c in ("vec_id", "label"))
        vectors = matrix(block.column("v").combine_chunks(), block.num_rows)
        windows = [block.column(c).filter(pa.array(asks)).to_pylist() for c in ("tops", "leasts")]
        rows, row_ids, row_labels = vectors[~asks], ids[~asks], labels[~asks]
        anchors, anchor_ids, anchor_labels = vectors[asks], ids[asks], labels[asks]
        kept = [Kept(tops, leasts, k) for tops, leasts in zip(*windows)]
        # One order of dimensions for both sides, the heaviest first.
        order = np.argsort(-(rows ** 2).sum(0), kind="stable")
        rows, anchors = rows[:, order], anchors[:, order]
        rest = rest_norms(anchors)
        for start in range(0, len(rows), CHUNK):
            chunk, chunk_ids, chunk_labels = (x[start:start + CHUNK] for x in (rows, row_ids, row_labels))
            least = np.array([min(o.leasts) for o in kept])
            # Anchors with like thresholds share a tile, so that one low threshold does not fill every tile's index.
            by_least = np.argsort(-least, kind="stable")
            for first in range(0, len(anchors), TILE):
                tile = by_least[first:first + TILE]
                index = Index(chunk, rest[tile, 0].max(), least[tile].min())
                a, r = index.pairs(anchors[tile], rest[tile], least[tile])
                cuts = np.searchsorted(a, np.arange(tile.size + 1))
                for n, own in enumerate(tile):
                    near = r[cuts[n]:cuts[n + 1]]
                    near = near[((chunk_labels[near] == anchor_labels[own]) == same_label) & (chunk_ids[near] != anchor_ids[own])]
                    if near.size:
                        kept[own].offer(chunk[near] @ anchors[own], chunk_ids[near])
        out = [(np.full(o.ids[w].size, i), np.full(o.ids[w].size, top), o.ids[w], o.scores[w])
               for i, o in zip(anchor_ids, kept) for w, top in enumerate(o.tops)]
        columns = [np.concatenate([np.empty(0, t), *(o[n] for o in out)]).astype(t)
                   for n, t in enumerate((np.int64, np.float64, np.int64, np.int64))]
        return pa.table(dict(zip(("anchor_id", "top", "found_id", "score"), columns)))

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k first rows of every window, over all blocks."""
    order = Window.partitionBy("anchor_id", "top").orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _filled(rows: DataFrame, windows: DataFrame, steps: list[Column], k: int, keys: list[str], same_label: bool,
            row_block: int, anchor_block: int) -> DataFrame:
    """The k first rows of each window (anchor columns, top): its threshold goes down the steps until k rows reach it."""
    full: list[DataFrame] = []
    for step in steps:
        asking = windows.withColumn("_least", step).groupBy("vec_id", "label", "v").agg(
            F.sort_array(F.collect_list(F.struct("top", "_least"))).alias("_w")).select(  # at most one window a positive
            "vec_id", "label", "v", F.col("_w.top").alias("tops"), F.col("_w._least").alias("leasts"))
        found = _blocks(rows, asking, keys, row_block, anchor_block).applyInArrow(_joined(k, same_label), FOUND)
        best = written(_first(found, k), "found")
        if step is steps[-1]:
            break
        done = best.filter(F.col("rank") == k).select("anchor_id", "top")
        full.append(best.join(done, ["anchor_id", "top"], "left_semi"))
        windows = written(windows.join(done.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "top"], "left_anti"), "windows")
        if windows.isEmpty():
            best = full.pop()
            break
    return reduce(DataFrame.unionByName, full, best)


def guessed(rows: DataFrame, anchors: DataFrame, sample: int) -> DataFrame:
    """Anchors with ``guess``, a first threshold: what one pair in a hundred of a sample reaches, for an anchor of the same norm."""
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toPandas()
    points = np.stack(picked["v"].to_numpy()) if len(picked) else np.zeros((1, 1))
    norm = np.sqrt((points ** 2).sum(1)).mean()
    promise = float(np.quantile(points[:256] @ points.T, 0.99) / max(norm, 1.0))
    return anchors.withColumn("guess", F.lit(promise) * F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)))


def mined(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: tuple[int, int] = (80, 100),
          sample: int = SAMPLE, row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """Each anchor's and positive's first rows of other labels with ``low[0] * positive <= low[1] * score <= low[1] * positive``.

    ``rows`` are (vec_id, label, v) with v whole numbers in doubles. Returns (anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score).
    """
    rows = written(rows.select("vec_id", "label", "v", F.xxhash64("vec_id", F.monotonically_increasing_id()).alias("salt")), "vectors")
    anchors = rows.filter(is_anchor).groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("_a")).select("vec_id", "_a.label", "_a.v")
    none = F.lit(float("-inf"))
    windows = written(guessed(rows, anchors, sample).withColumn("top", F.lit(float("inf"))), "anchors")
    likely = _filled(rows, windows, [F.col("guess"), F.col("guess") / 2, none], positives, ["label"], True, row_block, anchor_block)
    likely = written(likely.select("anchor_id", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # Positives with equal scores share a window; a negative score has none.
    tops = likely.filter("positive_score >= 0").select(F.col("anchor_id").alias("vec_id"), F.col("positive_score").cast("double").alias("top"))
    windows = written(tops.distinct().join(windows.drop("top", "guess"), "vec_id"), "windows")
    end = -F.floor(-F.col("top").cast("bigint") * low[0] / low[1])
    # The quotient is a double; whole numbers settle the end.
    end = F.when((end - 1) * low[1] >= F.col("top") * low[0], end - 1).when(end * low[1] < F.col("top") * low[0], end + 1).otherwise(end)
    first = F.col("top") - (F.col("top") - end) * UPPER
    found = _filled(rows, windows, [c.cast("double") for c in (first, end)], negatives, [], False, row_block, anchor_block)
    found = found.select("anchor_id", F.col("top").cast("bigint").alias("positive_score"), "rank", F.col("found_id").alias("negative_id"),
                         F.col("score").alias("negative_score"))
    return likely.join(found, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
