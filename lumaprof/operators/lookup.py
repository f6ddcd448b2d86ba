"""Interval and as-of lookups written as equi-joins.

Both spread their work by *cell* (a slice of the address or time axis), and wide
cells by salt, so a module, event or mapping that holds most of the rows is still
many tasks. Numberings, merges and sweeps run in slices of the order.
"""

from __future__ import annotations

from collections.abc import Sequence
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaprof.operators.reuse import cut


#: Copies of the intervals of one size that salting may make, and the most salts of a size.
SALT_COPIES, MOST_SALTS = 65_536, 256


def _level(lo: str, hi: str) -> Column:
    """Smallest ``k`` with ``2**k >= hi - lo``; one interval meets at most 2 cells of that size."""
    span = F.expr(f"{hi} - {lo} - 1")
    return F.when(span <= 0, F.lit(0)).otherwise(F.length(F.bin(span))).cast("int")


def filed_and_probed(points: DataFrame, intervals: DataFrame, point: str, lo: str, hi: str) -> tuple[DataFrame, DataFrame]:
    """Intervals and points under ``_level``, ``_cell`` and ``_salt``; see ``containing``."""
    real = intervals.filter(F.col(hi) > F.col(lo)).withColumn("_level", _level(lo, hi))
    counts = real.groupBy("_level").agg(F.count(F.lit(1)).alias("_n")).select(
        "_level", F.least(F.greatest(F.floor(SALT_COPIES / F.col("_n")), F.lit(1)), F.lit(MOST_SALTS)).cast("int").alias("_salts"))
    # At most 64 sizes.
    sizes = counts.agg(F.collect_list(F.struct("_level", "_salts"))).scalar()
    cells = F.array_distinct(F.array(F.expr(f"shiftright({lo}, _level)"), F.expr(f"shiftright({hi} - 1, _level)")))
    filed = (real.join(F.broadcast(counts), "_level").withColumn("_cell", F.explode(cells))
             .withColumn("_salt", F.explode(F.expr("sequence(0, _salts - 1)"))).drop("_salts"))
    probed = points.withColumn("_size", F.explode(sizes)).select(
        *points.columns, F.col("_size._level").alias("_level"), F.expr(f"shiftright({point}, _size._level)").alias("_cell"),
        F.expr(f"cast(pmod(xxhash64({point}), _size._salts) as int)").alias("_salt"))
    return filed, probed


def containing(points: DataFrame, intervals: DataFrame, point: str, lo: str, hi: str, by: Sequence[str] = ()) -> DataFrame:
    """Inner join of each point to every interval ``[lo, hi)`` that holds it.

    An interval is filed in cells as large as itself, so it meets two cells at
    most; a point looks in one cell per interval size in use (at most 64). Wide
    cells hold many points but there are few intervals as wide: those are copied
    under salts, and a point looks under one salt of its own. So one interval over
    the whole range is up to ``MOST_SALTS`` join keys, and sizes with many
    intervals, which lie in many cells, are not copied.
    """
    filed, probes = filed_and_probed(points, intervals, point, lo, hi)
    hits = probes.join(filed, [*by, "_level", "_cell", "_salt"])
    return hits.filter((F.col(point) >= F.col(lo)) & (F.col(point) < F.col(hi))).drop("_level", "_cell", "_salt")


def latest_before(points: DataFrame, marks: DataFrame, by: Sequence[str], point: str, mark: str,
                  payload: Sequence[str], page_bits: int = 16, strict: bool = False) -> DataFrame:
    """As-of join: each distinct ``(by, point)`` with the payload of the greatest mark <= point.

    ``marks`` holds one row per ``(by, mark)``. Rows are paged by ``point >> page_bits``:
    a window runs inside each page, and one more over pages carries the last
    earlier mark in, so no window ever spans a whole ``by`` group of rows.
    ``strict`` asks for marks below the point.
    """
    keys = [F.col(k) for k in by]
    mark_rows = marks.select(
        *keys, F.col(mark).alias("_at"), F.lit(1 if strict else 0).alias("_kind"),
        F.struct(F.col(mark).alias(mark), *payload).alias("_mark"))
    point_rows = points.select(*keys, F.col(point).alias("_at")).distinct().withColumn(
        "_kind", F.lit(0 if strict else 1))
    page = F.shiftright("_at", page_bits).alias("_page")
    rows = point_rows.unionByName(mark_rows, allowMissingColumns=True).select("*", page)

    in_page = Window.partitionBy(*by, "_page").orderBy("_at", "_kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumn("_local", F.last("_mark", ignorenulls=True).over(in_page)).filter(
        F.col("_kind") == (0 if strict else 1))

    pages = (
        mark_rows.select("*", page).groupBy(*by, "_page").agg(F.max_by("_mark", "_at").alias("_last"))
        .unionByName(point_rows.select(*by, page).distinct(), allowMissingColumns=True)
        .groupBy(*by, "_page").agg(F.max("_last").alias("_last"))
    )
    before = Window.partitionBy(*by).orderBy("_page").rowsBetween(Window.unboundedPreceding, -1)
    carry = pages.select(*by, "_page", F.last("_last", ignorenulls=True).over(before).alias("_carry"))

    found = F.coalesce(F.col("_local"), F.col("_carry"))
    return (
        local.join(carry, [*by, "_page"], "left")
        .withColumn("_found", found)
        .select(*by, F.col("_at").alias(point), *[F.col(f"_found.{c}").alias(c)
                                                  for c in dict.fromkeys([mark, *payload])])
    )


def sliced(df: DataFrame, order: Sequence[str], slice_rows: int | None = None) -> DataFrame:
    """Rows with ``_slice``: consecutive ranges of the order, one per shuffle partition, or of about ``slice_rows`` each."""
    # Without a size the session's partitions decide, and nothing has to be counted first.
    ranges = df.repartitionByRange(max(1, -(-df.count() // slice_rows)), *order) if slice_rows else df.repartitionByRange(*order)
    return cut(ranges.withColumn("_slice", F.spark_partition_id()))


def merged_before(points: DataFrame, marks: DataFrame, by: Sequence[str], point: str, mark: str,
                  payload: Sequence[str], slice_rows: int | None = None) -> DataFrame:
    """As-of join by a merge: each distinct ``(by, point)`` with the payload of the greatest mark <= point.

    Points and marks (one per ``(by, mark)``) are one ordered set that is cut at
    shared bounds; a window runs inside each range, and the last mark of the ranges
    before it is carried in from a table with one row per range.
    """
    keys = [F.col(k) for k in by]
    mark_rows = marks.select(*keys, F.col(mark).alias("_at"), F.lit(0).alias("_kind"), F.struct(*dict.fromkeys([mark, *payload])).alias("_mark"))
    point_rows = points.select(*keys, F.col(point).alias("_at")).distinct().withColumn("_kind", F.lit(1))
    rows = sliced(point_rows.unionByName(mark_rows, allowMissingColumns=True), [*by, "_at", "_kind"], slice_rows)
    ends = rows.groupBy(*by, "_slice").agg(F.max_by("_mark", F.when(F.col("_kind") == 0, F.col("_at"))).alias("_last"))
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_slice", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    inside = Window.partitionBy(*by, "_slice").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("_local", F.last("_mark", ignorenulls=True).over(inside)).filter("_kind = 1").join(carried, [*by, "_slice"])
    hit = F.coalesce("_local", "_carried")
    return found.withColumn("_hit", hit).select(
        *by, F.col("_at").alias(point), *[F.col(f"_hit.{c}").alias(c) for c in dict.fromkeys([mark, *payload])])


#: Interval ends that one slice of a sweep holds.
SWEPT_ROWS = 50_000
#: Levels of the tree over slices; enough for 2**24 of them.
LEVELS = 24


def _covering(ends: DataFrame, order: Sequence[str]) -> DataFrame:
    """For every slice, the first interval by ``order`` that is open all through it: one row per such slice.

    An interval over many slices is filed under the nodes of a binary tree over
    slices that make up its inner ones, two per level at most; a slice takes the
    first one of the nodes above it.
    """
    row = F.struct(*[c for c in ends.columns if c not in ("_slice", "_kind", "_at")])
    spans = ends.groupBy("_id").agg(F.min("_slice").alias("_from"), F.max("_slice").alias("_to"), F.any_value(row).alias("_row")).filter("_to - _from > 1")
    nodes = F.expr(f"""flatten(transform(sequence(0, {LEVELS}), k -> filter(array_distinct(array(
        named_struct('level', k, 'node', shiftright(_from + shiftleft(1, k), k), 'use', shiftright(_from + shiftleft(1, k), k) % 2 = 1),
        named_struct('level', k, 'node', shiftright(_to, k) - 1, 'use', shiftright(_to, k) % 2 = 1))),
        n -> n.use and shiftright(_from + shiftleft(1, k), k) < shiftright(_to, k))))""")
    first = F.min_by("_row", F.struct(*[F.col(f"_row.{c}") for c in order]))
    filed = spans.select(F.explode(nodes).alias("_n"), "_row").groupBy("_n.level", "_n.node").agg(first.alias("_row"))
    above = ends.select("_slice").distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    over = above.withColumn("node", F.expr("shiftright(_slice, level)")).join(filed, ["level", "node"])
    return over.groupBy("_slice").agg(first.alias("_row")).select("_slice", "_row.*", F.lit(2).alias("_kind"), F.lit(None).cast("bigint").alias("_at"))


def _sweep(by: Sequence[str], order: Sequence[str], out: Sequence[str]):
    """Goes over the interval ends of a slice with a heap of the open intervals; a row wherever the first one of them changes."""
    def run(rows: pa.Table) -> pa.Table:
        ranked = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in order], null_placement="at_start"))
        ids, kinds, ats = (ranked.column(c).to_pylist() for c in ("_id", "_kind", "_at"))
        groups = list(zip(*(ranked.column(c).to_pylist() for c in by))) if by else [()] * len(ids)
        first: dict[int, int] = {}  # rank of an interval: where it stands first
        for n, one in enumerate(ids):
            first.setdefault(one, n)
        started = {one for one, kind in zip(ids, kinds) if kind == 0}
        changes: dict[tuple, dict[int, list[tuple[int, int]]]] = {}
        opened: dict[tuple, list[int]] = {}
        for group, one, kind, at in zip(groups, ids, kinds, ats):
            if kind != 2:
                changes.setdefault(group, {}).setdefault(at, []).append((kind, first[one]))
            if kind != 0 and one not in started:
                opened.setdefault(group, []).append(first[one])
        where, picked, owner = [], [], []
        for group, points in changes.items():
            heap, closed, last = opened.get(group, []), set(), -1
            heapify(heap)
            for at in sorted(points):
                for kind, rank in points[at]:
                    if kind == 0:
                        heappush(heap, rank)
                    else:
                        closed.add(rank)
                while heap and heap[0] in closed:
                    heappop(heap)
                now = heap[0] if heap else None
                if now != last:
                    where.append(at)
                    picked.append(now)
                    owner.append(points[at][0][1])
                    last = now
        narrowest = ranked.take(pa.array(picked, pa.int64()))
        owners = ranked.take(pa.array(owner, pa.int64()))
        return pa.table([*(owners.column(c) for c in by), pa.array(where, pa.int64()), *(narrowest.column(c) for c in out)],
                        names=[*by, "_at", *out])

    return run


def segments(intervals: DataFrame, lo: str, hi: str, order: Sequence[str], payload: Sequence[str], by: Sequence[str] = (),
             slice_rows: int | None = None) -> DataFrame:
    """Elementary segments ``(by, _at, payload)``: from ``_at`` on, the first by ``order`` of the intervals ``[lo, hi)`` there; null in gaps.

    A slice is swept in one Python worker, so it holds ``SWEPT_ROWS`` ends if no
    other size is asked for, whatever the size of the table. The interval ends are cut into slices; a slice knows the intervals that start or
    end in it, and the first one of those that only pass through.
    """
    columns = list(dict.fromkeys([*by, *order, *payload]))
    real = intervals.filter(F.col(hi) > F.col(lo)).select(*columns, F.array(lo, hi).alias("_ends"), F.monotonically_increasing_id().alias("_id"))
    ends = sliced(real.select(*columns, "_id", F.posexplode("_ends").alias("_kind", "_at")), [*by, "_at"], slice_rows or SWEPT_ROWS)
    types = dict(intervals.dtypes)
    out = list(dict.fromkeys(payload))
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in by), "_at bigint", *(f"`{c}` {types[c]}" for c in out)])
    return ends.unionByName(_covering(ends, order)).groupBy("_slice").applyInArrow(_sweep(by, order, out), schema)


def first_containing(points: DataFrame, intervals: DataFrame, point: str, lo: str, hi: str, order: Sequence[str],
                     payload: Sequence[str], by: Sequence[str] = (), slice_rows: int | None = None) -> DataFrame:
    """Each distinct ``(by, point)`` that lies in an interval, with the payload of the first one by ``order``: one as-of step a point.

    ``payload`` must hold a column that is never null.
    """
    # Finding the bounds of the merge reads them once more, and would sweep again.
    pieces = cut(segments(intervals, lo, hi, order, payload, by, slice_rows))
    found = merged_before(points, pieces, by, point, "_at", payload, slice_rows).drop("_at")
    return found.filter(F.coalesce(*[F.when(F.col(c).isNotNull(), True) for c in payload]))


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """0-based numbers in ``order`` within ``by`` of rows that ``sliced`` has cut along (by, order)."""
    counts = rows.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    # One row per slice (and group that begins in it) from here.
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_slice").orderBy(*order)
    return (
        rows.withColumn("_row", F.row_number().over(inside)).join(starts, [*by, "_slice"])
        .withColumn(name, F.col("_start") + F.col("_row") - 1).drop("_slice", "_row", "_start"))


def dense_ids(df: DataFrame, order: Sequence[str], name: str, slice_rows: int | None = None) -> DataFrame:
    """0-based ids in ``order`` over the whole table, without sorting it in one task."""
    return numbered(sliced(df, order, slice_rows), [], order, name)
