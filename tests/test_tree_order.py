"""Pre-order numbers, path sums, nested call tree documents and chains of labels."""

import json
import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

from pyspark.sql import functions as F

from lumaprof.operators import callstacks, layout, tree_order
from lumaprof.sinks import report

THREAD = ["event", "pid", "tid"]


def stacks_of(spark, stacks):
    rows = [("e", 1, tid, w, 1, [(f, 0, f"n{f % 5}") for f in reversed(path)]) for tid, path, w in stacks]
    return spark.createDataFrame(rows, "event string, pid bigint, tid bigint, weight bigint, samples bigint, "
                                 "calls array<struct<func:bigint,lib:bigint,name:string>>")


def some_stacks():
    random.seed(5)
    made = [(tid, [random.randrange(4) for _ in range(random.randrange(1, 9))], random.randrange(1, 50)) for tid in (1, 2) for _ in range(120)]
    return made + [(3, [7], 4), (4, list(range(150)), 9), (4, [*range(90), 200, 201], 2)]


def nested(stacks, tid):
    """The document as plain nested dictionaries."""
    root = {"e": 0, "s": 0, "f": -1, "c": {}}
    for owner, path, w in stacks:
        if owner == tid:
            node = root
            node["s"] += w
            for f in path:
                node = node["c"].setdefault(f, {"e": 0, "s": 0, "f": f, "c": {}})
                node["s"] += w
            node["e"] += w

    def listed(node):
        children = sorted(node["c"].values(), key=lambda c: (f"n{c['f'] % 5}", c["f"]))
        return {**node, "c": [listed(c) for c in children]}

    return listed(root)


def test_documents_equal_nested_ones(spark, tmp_path):
    stacks = some_stacks()
    ordered = tree_order.preorder(callstacks.call_tree(stacks_of(spark, stacks)), THREAD)
    lines = report.tree_documents(ordered, THREAD)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        report.write_tree_documents(lines, THREAD, str(tmp_path / "trees"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    most = 0
    sys.setrecursionlimit(10_000)
    for tid in (1, 2, 3, 4):
        files = sorted((tmp_path / "trees" / "event=e" / "pid=1" / f"tid={tid}").glob("part-*"))
        most = max(most, len(files))
        assert json.loads("".join(f.read_text() for f in files)) == nested(stacks, tid)
    assert most > 1  # some document was written by several tasks


def test_a_subtree_is_a_range(spark):
    ordered = tree_order.preorder(callstacks.call_tree(stacks_of(spark, some_stacks())), THREAD).collect()
    by_thread = defaultdict(list)
    for r in ordered:
        by_thread[r.tid].append(r)
    for rows in by_thread.values():
        assert sorted(r.entry for r in rows) == list(range(1, len(rows) + 1))
        up = {r.node: r.parent for r in rows}
        for a in rows[::7]:
            below = set()
            for b in rows:
                at = up.get(b.node)
                while at is not None:
                    if at == a.node:
                        below.add(b.entry)
                    at = up.get(at)
            assert below == set(range(a.entry + 1, a.exit + 1))


def test_empty_tree_has_no_document(spark):
    ordered = tree_order.preorder(callstacks.call_tree(stacks_of(spark, some_stacks()).limit(0)), THREAD)
    assert report.tree_documents(ordered, THREAD).count() == 0


def test_all_boxes_of_a_deep_flame(spark):
    deep = [(1, list(range(300)), 3), (1, [*range(200), 999], 1)]
    found = {(r.depth, r["name"]): r for r in layout.flame(stacks_of(spark, deep), 0.0).collect()}
    assert len(found) == 301
    assert found[299, "n4"].x == 0 and found[299, "n4"].width == 75
    tail = [r for r in found.values() if r.depth == 200]
    assert sorted((r["name"], r.x, r.width) for r in tail) == [("n0", 0, 75), ("n4", 75, 25)]


def test_path_sums_against_brute_force(spark):
    random.seed(8)
    parents = {n: (random.randrange(max(0, n - 3), n) if n else None) for n in range(400)}
    depth = {}
    for n, p in parents.items():
        depth[n] = 1 if p is None else depth[p] + 1
    weight = {n: random.randrange(100) for n in parents}
    rows = spark.createDataFrame([("k", n, p, depth[n], weight[n]) for n, p in parents.items()], "k string, node int, parent int, depth int, w bigint")
    sums = {r.node: r.total for r in tree_order.path_sums(rows, ["k"], "w", "total").collect()}
    expected, sizes = {}, Counter()
    for n, p in parents.items():
        expected[n] = weight[n] + (0 if p is None else expected[p])
        while n is not None:
            sizes[n] += 1
            n = parents[n]
    assert sums == expected
    assert {r.node: r["size"] for r in tree_order.subtree_sizes(rows, ["k"]).collect()} == dict(sizes)


def test_numbering_leaves_one_narrow_table(spark):
    """The rounds' tables are gone afterwards, and what stays is a compressed table of the nodes."""
    from lumaprof.operators.reuse import shared_dir

    root = Path(shared_dir(spark).removeprefix("file:"))
    stored = lambda: {p: p.stat().st_size for p in root.rglob("*") if p.is_file()}
    rows = spark.range(20_000).selectExpr(
        "'e' AS event", "1L AS pid", "id % 3 AS tid", "id AS node", "if(id < 30, null, id div 10 - id div 10 % 3 + id % 3) AS parent",
        "if(id < 30, 1, if(id < 300, 2, if(id < 3000, 3, 4))) AS depth", "id AS func", "concat('f', id) AS name", "1L AS self", "1L AS subtree")
    before = stored()
    ordered = tree_order.preorder(rows, THREAD).collect()
    added = sum(size for path, size in stored().items() if path not in before)
    assert added < 60 * 20_000
    entries = {(r.tid, r.node): r for r in ordered}
    assert all(sorted(r.entry for r in ordered if r.tid == t) == list(range(1, 1 + sum(r.tid == t for r in ordered))) for t in range(3))
    assert all(entries[r.tid, r.parent].entry < r.entry <= r.exit <= entries[r.tid, r.parent].exit for r in ordered if r.depth > 1)
