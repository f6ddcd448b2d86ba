"""SimHash near-duplicates, found with a vantage-point tree over Hamming distance.

Fingerprints are 64-bit majorities of word shingle hashes. Equal fingerprints are
one node. A vantage-point tree, fitted on a bounded hashed sample of the nodes,
deals all nodes into shards: at every tree node the distance to its vantage point
decides the side, and a node whose ball of ``bits`` reaches over the boundary also
visits the other side (by the triangle inequality nothing else can be that close).
Each pair is sought from the inner side only. Inside a shard the same tree goes on
locally and ends in direct comparisons, so the pairs are exact. Shards that stay
large (dense balls no vantage point can split) are cut into blocks.

A shard passes on one edge per linked node, towards the least node linked there,
not all its pairs; components are contracted over those edges.

Null and blank texts have fingerprint zero and are linked like any other. Rows
with a null id keep their fingerprint and take part; a component's id is the least
id in it that is not null. Repeated rows are one node and all are returned. Texts of
any length count with all their shingles; an empty table gives no row. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from lumaprof.llm.common import join_by_share, slices, written
from lumaprof.llm.components import components

#: Fingerprints that the tree is fitted on; all fingerprints are dealt by it.
TREE_SAMPLE = 32_768
#: Fingerprints a shard should hold, and the most that one task gets as members and as visitors.
SHARD_GOAL, MEMBER_BLOCK, VISITOR_BLOCK = 8_192, 65_536, 262_144
#: Local comparisons are direct from this many members down.
DIRECT = 192

_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, words: int) -> list[bytes]:
    """Big-endian XXH64 (seed 42) of every word shingle; a shorter text is one shingle, a blank one none."""
    found = text.lower().split()
    if len(found) > words:
        return [xxh64_digest(s, 42) for s in map(b" ".join, zip(*(islice(found, n, None) for n in range(words))))]
    return [xxh64_digest(b" ".join(found), 42)] if found else []


def majorities(hashes: list[list[bytes]]) -> np.ndarray:
    """Per text, the bits set in over half of its hashes; zero for a text without hashes."""
    counts = np.array([len(h) for h in hashes], np.int64)
    result = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(counts)
    if not full.size:
        return result
    values = np.frombuffer(b"".join([b"".join(hashes[i]) for i in full]), ">u8").astype("<u8")
    starts = np.concatenate([[0], np.cumsum(counts[full])])
    # Eight bits are counted at a time in the bytes of one integer, over at most 255 hashes.
    blocks = np.concatenate([np.arange(a, b, 255) for a, b in zip(starts[:-1], starts[1:])])
    firsts = np.searchsorted(blocks, starts[:-1])
    for bit in range(8):
        lanes = np.add.reduceat((values >> np.uint64(bit)) & _LANES, blocks)
        by_text = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), firsts, axis=0)
        over = (2 * by_text > counts[full, None]).astype(np.uint64)
        for lane in range(8):
            result[full] |= over[:, lane] << np.uint64(8 * lane + bit)
    return result


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed 64-bit integer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                prints = majorities([shingle_hashes(t or b"", words) for t in texts]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def _split(points: np.ndarray, bits: int, seed: int) -> tuple[np.uint64, int, np.ndarray] | None:
    """The vantage point and radius with the least mass at the boundary that keeps both sides apart."""
    best = None
    for vantage in np.random.default_rng(seed).choice(points, min(8, points.size), replace=False):
        far = _distance(points, vantage)
        below = np.cumsum(np.bincount(far, minlength=65))
        for radius in range(64):
            inner = below[radius]
            if 5 * inner < points.size or 5 * inner > 4 * points.size:
                continue
            shell = inner - (below[radius - bits] if radius >= bits else 0)
            cost = shell + abs(2 * inner - points.size) / 4
            if best is None or cost < best[0]:
                best = (cost, vantage, radius, far)
    return None if best is None else best[1:]


def fit_tree(sample: np.ndarray, total: int, bits: int, goal: int) -> list[tuple]:
    """Nodes (vantage, radius, inner child, outer child), or (None, shard) for a leaf; the root is the first."""
    tree: list = [None]
    shards, open_nodes = 0, [(0, sample)]
    while open_nodes:
        at, points = open_nodes.pop()
        wanted = points.size * total > goal * sample.size and points.size >= 64
        found = _split(points, bits, at) if wanted else None
        if found is None:
            tree[at] = (None, shards)
            shards += 1
            continue
        vantage, radius, far = found
        tree[at] = (vantage, radius, len(tree), len(tree) + 1)
        tree += [None, None]
        open_nodes += [(tree[at][2], points[far <= radius]), (tree[at][3], points[far > radius])]
    return tree


def routed(prints: np.ndarray, tree: list[tuple], bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, indexes of members, indexes of visitors) for all prints."""
    todo = [(0, np.arange(prints.size), np.empty(0, np.int64))]
    while todo:
        at, members, visitors = todo.pop()
        if not members.size and not visitors.size:
            continue
        node = tree[at]
        if node[0] is None:
            yield node[1], members, visitors
            continue
        vantage, radius, inner, outer = node
        far, seen = _distance(prints[members], vantage), _distance(prints[visitors], vantage)
        over = members[(far <= radius) & (far > radius - bits)]
        todo.append((inner, members[far <= radius], visitors[seen <= radius + bits]))
        todo.append((outer, members[far > radius], np.concatenate([visitors[seen > radius - bits], over])))


class _Links:
    """Union of linked indexes, kept as the least index each one reaches."""

    def __init__(self, size: int):
        self.least = np.arange(size)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        least = self.least
        while a.size:
            ra, rb = least[a], least[b]
            low = np.minimum(ra, rb)
            np.minimum.at(least, np.maximum(ra, rb), low)
            while True:
                jumped = least[least]
                if np.array_equal(jumped, least):
                    break
                least[:] = jumped
            apart = least[a] != least[b]
            a, b = a[apart], b[apart]


def _seek(prints: np.ndarray, members: np.ndarray, visitors: np.ndarray, bits: int, links: _Links) -> None:
    """Link every visitor to every member within ``bits``; the members visit each other too."""
    todo = [(members, np.concatenate([members, visitors]))]
    while todo:
        inside, seekers = todo.pop()
        if not inside.size or not seekers.size:
            continue
        found = _split(prints[inside], bits, inside.size) if inside.size > DIRECT else None
        if found is None:
            step = max(1, (1 << 21) // inside.size)
            for at in range(0, seekers.size, step):
                own = seekers[at:at + step]
                a, b = np.nonzero(np.bitwise_count(prints[own][:, None] ^ prints[inside][None, :]) <= bits)
                links.add(own[a], inside[b])
            continue
        vantage, radius, far = found
        seen = _distance(prints[seekers], vantage)
        todo.append((inside[far <= radius], seekers[seen <= radius + bits]))
        todo.append((inside[far > radius], seekers[seen > radius - bits]))


def links(nodes: DataFrame, bits: int, sample: int = TREE_SAMPLE, goal: int = SHARD_GOAL,
          member_block: int = MEMBER_BLOCK, visitor_block: int = VISITOR_BLOCK) -> DataFrame:
    """Edges (u, v) that connect all distinct ``fp`` of ``nodes`` within ``bits`` of each other."""
    total = nodes.count()
    picked = nodes.filter(F.pmod(F.xxhash64("fp"), F.lit(max(total, 1))) < sample).select("fp").toPandas()["fp"]
    tree = fit_tree(np.sort(picked.to_numpy(np.int64)).view(np.uint64), total, bits, goal)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fp").to_numpy(zero_copy_only=False)
            for shard, members, visitors in routed(prints.view(np.uint64), tree, bits):
                both = np.concatenate([members, visitors])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prints[both]), pa.array(np.full(both.size, shard, np.int32)),
                     pa.array(np.arange(both.size) < members.size)], ["fp", "shard", "member"])

    dealt = written(nodes.select("fp").mapInArrow(deal, "fp bigint, shard int, member boolean"), "dealt")
    sizes = dealt.groupBy("shard").agg(
        F.ceil(F.count_if("member") / member_block).cast("int").alias("_member_blocks"),
        F.ceil(F.count("*") / visitor_block).cast("int").alias("_visitor_blocks"))
    # One row per shard of a tree fitted on a bounded sample: it has at most sample / 12 leaves.
    sized = dealt.join(F.broadcast(sizes), "shard").filter("_member_blocks > 0")
    own = F.pmod(F.xxhash64("fp"), F.col("_member_blocks")).cast("int")
    seat = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("_visitor_blocks")).cast("int")
    as_member = sized.filter("member").withColumn("mb", own).withColumn("vb", F.explode(F.expr("sequence(0, _visitor_blocks - 1)")))
    as_visitor = sized.withColumn("vb", seat).withColumn("mb", F.explode(F.expr("sequence(0, _member_blocks - 1)"))) \
        .filter(~F.col("member") | (F.col("mb") != own) | (F.col("_visitor_blocks") > 1)).withColumn("member", F.lit(False))
    blocks = as_member.unionByName(as_visitor).select("shard", "mb", "vb", "fp", "member")

    def pairs(block: pa.Table) -> pa.Table:
        prints = block.column("fp").to_numpy()
        order = np.argsort(prints, kind="stable")
        prints = prints[order]
        is_member = block.column("member").to_numpy()[order]
        # A print that is both member and visitor of a block is one index.
        values, index = np.unique(prints, return_inverse=True)
        members = np.unique(index[is_member])
        visitors = np.setdiff1d(np.unique(index[~is_member]), members)
        found = _Links(values.size)
        _seek(values.view(np.uint64), members, visitors, bits, found)
        linked = np.flatnonzero(found.least != np.arange(values.size))
        return pa.table({"u": values[linked], "v": values[found.least[linked]]})

    return blocks.groupBy("shard", "mb", "vb").applyInArrow(pairs, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2, **limits: int) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``; see the module's text."""
    prints = written(fingerprints(docs, words), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies")), "nodes")
    roots = components(links(nodes, bits, **limits))
    labelled = written(nodes.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "labelled")
    found = written(labelled.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("_n")), "found")
    by_print = join_by_share(labelled.select("fp", "copies", "root"), found, "root", "_n").select("fp", "copies", "component_id")
    rows = join_by_share(prints, written(by_print, "by_print"), "fp", "copies")
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
