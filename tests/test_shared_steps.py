"""Steps that many queries share: bounded sweeps and aggregations by hash."""

from pyspark.sql import functions as F

from lumaprof.functions import metric_value as M
from lumaprof.operators import callstacks, lookup, reuse, stack_text


def test_cut_is_a_table_in_columns(spark):
    """A later step reads the columns it asks for, and no plan before the cut."""
    rows = spark.range(50).selectExpr("id", "repeat('long', 200) AS text", "map('a', struct(id AS n)) AS m", "array(id) AS l")
    held = reuse.cut(rows)
    assert sorted(map(tuple, held.select("id", "text").collect())) == sorted(map(tuple, rows.select("id", "text").collect()))
    assert [r.m["a"].n for r in held.orderBy("id").collect()] == list(range(50))
    plan = held.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "parquet" in plan and "text" not in plan


def test_segments_are_swept_once(spark, monkeypatch):
    swept = spark.sparkContext.accumulator(0)
    sweep = lookup._sweep

    def counted(*names):
        run = sweep(*names)

        def one(rows):
            swept.add(1)
            return run(rows)

        return one

    monkeypatch.setattr(lookup, "_sweep", counted)
    spans = spark.range(40).selectExpr("id * 3 AS lo", "id * 3 + 2 AS hi", "id AS i")
    points = spark.range(120).selectExpr("id AS p")
    found = lookup.first_containing(points, spans, "p", "lo", "hi", ["i"], ["i"])
    assert {(r.p, r.i) for r in found.collect()} == {(3 * i + d, i) for i in range(40) for d in (0, 1)}
    assert swept.value == 1


def test_status_of_all_maps(spark):
    value = lambda state, number=None: f"named_struct('state', '{state}', 'value', cast({number or 'NULL'} AS double), 'reason', NULL)"
    rows = spark.sql(f"""SELECT map('a', {value('number', 1)}, 'b', {value('missing')}) AS x, map('c', {value('undefined')}) AS y
        UNION ALL SELECT map('a', {value('number', -1)}), map('c', {value('number')})
        UNION ALL SELECT map('a', {value('unresolved')}), map('c', {value('number', 2)})""")
    found = rows.select(M.row_status([F.col("x"), F.col("y")]).alias("s")).collect()
    assert sorted(r.s for r in found) == ["0", "NonZero|Missing|Undefined", "NonZero|Unresolved"]


def test_a_sweep_has_a_bounded_slice_without_being_asked(spark, monkeypatch):
    asked, real = [], lookup.sliced
    monkeypatch.setattr(lookup, "sliced", lambda df, order, slice_rows=None: asked.append(slice_rows) or real(df, order, slice_rows))
    monkeypatch.setattr(lookup, "SWEPT_ROWS", 10, raising=False)
    pieces = lookup.segments(spark.range(40).selectExpr("id * 3 AS lo", "id * 3 + 2 AS hi", "id AS i"), "lo", "hi", ["i"], ["i"])
    assert asked == [10]
    assert sorted((r._at, r.i) for r in pieces.collect() if r.i is not None) == [(3 * i, i) for i in range(40)]


def deepest_aggregate(rows):
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Aggregate(" in line][-1]


def test_samples_are_aggregated_by_hash(spark):
    rows = spark.createDataFrame(
        [("e", 1, 1, 5, "b", [("l", "x", 1, 1), ("l", "y", 2, 1)]), ("e", 1, 1, None, "a", [("l", "y", 2, 1)]), ("e", 1, 1, 5, "c", [("l", "z", 3, 1)])],
        "event string, pid bigint, tid bigint, time bigint, comm string, frames array<struct<lib:string,symbol:string,addr:bigint,len:bigint>>")
    names = callstacks.thread_names(rows)
    assert [r.thread_name for r in names.collect()] == ["c"]
    assert "HashAggregate" in deepest_aggregate(names)
    # A null time is the first: y, then x and z of the same time in the order of their places and names.
    functions = callstacks.dictionaries(rows)[1].orderBy("func_id")
    assert [r.symbol for r in functions.collect()] == ["y", "x", "z"]
    assert "HashAggregate" in deepest_aggregate(callstacks._frame_rows(rows, None))


def test_stacks_of_chains_are_told_apart_by_hash(spark, monkeypatch):
    kept, real = [], stack_text.cut
    monkeypatch.setattr(stack_text, "cut", lambda rows: kept.append(deepest_aggregate(rows)) or real(rows))
    maps = spark.createDataFrame([(1, 0, 960, 0, 0, "mod1", 1)], "mapping_id bigint, start bigint, end bigint, offset bigint, load_bias bigint, module_id string, pos bigint")
    symbols = spark.createDataFrame([("mod1", 64, 64, "f")], "module_id string, address bigint, size bigint, name string")
    samples = spark.createDataFrame([("k", c, 7, 64, 2, [128]) for c in (1, 2, 1)],
                                    "event_key string, cpu bigint, tid bigint, ip bigint, period bigint, callchain array<bigint>")
    row, = stack_text.callchains(samples, maps, symbols).collect()
    assert (row.sample_count, row.weight, row.cpu) == (3, 6.0, "1,2")
    assert "HashAggregate" in kept[0]
