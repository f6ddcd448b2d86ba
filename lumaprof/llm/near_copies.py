"""Near copies of texts: groups of rows whose five-word shingle sets have a Jaccard similarity of 0.8 or more.

Rows with equal shingle sets are one node. Candidates come from the components of
``simhash`` (fingerprints within two bits of each other, as ``op6_simhash`` links them):
a component is a band of its nodes. Texts that are similar lie further apart than that
as a rule, so minima of every node's set under 240 hash functions are banded as well
(48 bands of 5); nodes that share a band are candidates, and only candidates whose
whole sets are similar enough, counted exactly, are linked.
Two sets with a similarity of just 0.8 share no band with a chance of 5 in a billion.

Candidates are confirmed in two rounds: first every node against the least node of
each of its bands, then all pairs that share a band and are not yet in one component.
A group of copies around one text thus costs its size, not its square. Where many
nodes share a band but no component, all their pairs are compared by bitmaps of their
sets inside of tasks (cut into blocks); a bitmap bounds the common shingles from
above, so only pairs that cannot be similar are left out before they are rows.

Null and blank texts have the empty set and are copies of each other. A row is named
by 128 bits over all its columns, so repeated and null ids are rows like any other,
and no table copies the texts; rows equal in all columns are one. ``one_of_each``
keeps one row of each group: the least id, null ids last, then the least name. An
empty table gives no row; texts of any length are read whole; all columns of the
input are returned as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from lumaprof.llm import simhash
from lumaprof.llm.common import Scratch, slices
from lumaprof.llm.components import components
from lumaprof.llm.simhash import shingle_hashes

WORDS = 5
#: Words of a fingerprint's shingles and the bits in which linked fingerprints differ at most.
PRINT_WORDS, PRINT_BITS = 3, 2
#: Sets are similar if their intersection is at least 4/5 of their union.
SHARED, OF = 4, 5
BANDS, ROWS = 48, 5
#: Bytes of texts that are described, and that give sets, at once: their shingle hashes are some twenty times as large.
DESCRIBED_BYTES, SET_BYTES = 1 << 20, 2 << 20
#: Shingles hashed at once by all functions.
STEP = 256
#: Nodes of one band that a join pairs; of more, bitmaps (of so many bytes) are compared in blocks of so many nodes.
FEW, BITMAP, BLOCK = 32, 256, 4096

_SALT, _ODD = np.random.default_rng(5).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_ODD |= np.uint64(1)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(np.frombuffer(b"".join(shingle_hashes(text, WORDS)), ">u8").astype(np.uint64))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key per band; none for an empty set. Equal keys by chance only make a pair a candidate."""
    if not shingles.size:
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, shingles.size, STEP):
        np.minimum(least, ((shingles[at:at + STEP, None] ^ _SALT) * _ODD).min(axis=0), out=least)
    rows = (least * _ODD).reshape(BANDS, ROWS) ^ (least >> np.uint64(29)).reshape(BANDS, ROWS)
    return ((rows * _ODD[:ROWS]).sum(axis=1, dtype=np.uint64) ^ _SALT[:BANDS]).view(np.int64)


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets, bands and fingerprints of (one, two, doc_id, text), of a bounded number of bytes at once."""
    for batch in batches:
        for part in slices(batch, "text", DESCRIBED_BYTES):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            sets = [shingle_set(t or b"") for t in texts]
            prints = simhash.majorities([shingle_hashes(t or b"", PRINT_WORDS) for t in texts]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("one", "two", "doc_id")), pa.array([s.size for s in sets], pa.int32()),
                 pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                 pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())), pa.array(prints)],
                ["one", "two", "doc_id", "shingles", "digest", "bands", "fp"])


def _described(rows: DataFrame) -> DataFrame:
    """(one, two, doc_id, shingles, digest, bands, fp) of every row; ``one`` and ``two`` name the row."""
    return rows.mapInArrow(describe, "one bigint, two bigint, doc_id bigint, shingles int, digest binary, bands array<bigint>, fp bigint")


def _print_bands(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, shingles, band): the components of fingerprints as bands, named by their least fingerprint."""
    prints = scratch.written(nodes.select("node", "shingles", F.explode("prints").alias("fp")), "prints")
    roots = components(simhash.links(prints.select("fp").distinct(), PRINT_BITS))
    placed = prints.join(roots.withColumnRenamed("u", "fp"), "fp", "left")
    return placed.select("node", "shingles", F.coalesce("root", "fp").alias("band")).distinct()


def bitmap(shingles: np.ndarray) -> bytes:
    bits = np.zeros(8 * BITMAP, bool)
    bits[shingles % np.uint64(bits.size)] = True
    return np.packbits(bits).tobytes()


def possible(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """Which sets of ``a`` and ``b``, rows of bitmap words, can be similar: every bit of one alone is a shingle of it alone."""
    common = np.zeros((len(a), len(b)), np.int32)
    for word in range(a.shape[1]):
        common += np.bitwise_count(a[:, None, word] & b[None, :, word])
    bits_a, bits_b = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a, b))
    most = common + np.minimum((a_sizes - bits_a)[:, None], (b_sizes - bits_b)[None, :])
    return most * (SHARED + OF) >= (a_sizes[:, None] + b_sizes[None, :]) * SHARED


def _sets(rows: DataFrame) -> DataFrame:
    """(node, n, hashes, bits): the shingle set of every row, its size and its bitmap in words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SET_BYTES):
                sets = [shingle_set(t or b"") for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.array([s.size for s in sets], pa.int32()),
                     pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                     pa.array([np.frombuffer(bitmap(s), np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "n", "hashes", "bits"])

    return rows.mapInArrow(run, "node bigint, n int, hashes array<bigint>, bits array<bigint>")


def _of_like_size(a: str, b: str) -> Column:
    """Sets of too different sizes cannot be similar."""
    return F.least(a, b) * OF >= F.greatest(a, b) * SHARED


def _confirmed(pairs: DataFrame, sets: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (u, v) whose sets are similar, as a table; whole sets move only for pairs whose bitmaps allow it."""
    def sides(some: DataFrame, *columns: str) -> DataFrame:
        for side in ("u", "v"):
            some = some.join(sets.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)), side)
        return some

    def ones(words: Column) -> Column:
        return F.aggregate(words, F.lit(0), lambda total, w: total + F.bit_count(w))

    shared = ones(F.zip_with("bits_u", "bits_v", lambda x, y: x.bitwiseAND(y)))
    most = shared + F.least(F.col("n_u") - ones(F.col("bits_u")), F.col("n_v") - ones(F.col("bits_v")))
    near = sides(pairs, "n", "bits").filter(most * (SHARED + OF) >= (F.col("n_u") + F.col("n_v")) * SHARED).select("u", "v")
    common = F.size(F.array_intersect("hashes_u", "hashes_v"))
    whole = sides(scratch.written(near, f"{name}-near"), "n", "hashes")
    linked = scratch.written(whole.filter(common * (SHARED + OF) >= (F.col("n_u") + F.col("n_v")) * SHARED).select("u", "v"), name)
    scratch.drop(f"{name}-near")
    return linked


def _pairs_of_few(seats: DataFrame) -> DataFrame:
    other = seats.select("band", F.col("node").alias("v"), F.col("shingles").alias("v_shingles"), F.col("root").alias("v_root"))
    return (seats.join(other, "band").filter("node < v and root <> v_root").filter(_of_like_size("shingles", "v_shingles"))
            .select(F.col("node").alias("u"), "v"))


def _pairs_of_many(seats: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    own = F.pmod(F.xxhash64("node"), F.ceil(F.col("_n") / block)).cast("int")
    dealt = (seats.join(sets.select("node", "bits"), "node").withColumn("own", own)
             .withColumn("to", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / block).cast("int") - 1)))
             .select("band", F.least("own", "to").alias("a"), F.greatest("own", "to").alias("b"), "own", "node", "shingles", "root", "bits"))

    def run(rows: pa.Table) -> pa.Table:
        node, sizes, root, own = (rows.column(c).to_numpy() for c in ("node", "shingles", "root", "own"))
        words = rows.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
        first = np.flatnonzero(own == own.min())
        second = first if rows.column("a")[0] == rows.column("b")[0] else np.flatnonzero(own != own.min())
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        # A block that got no row of its partner block has no pair to seek.
        step = max(1, (1 << 21) // max(1, second.size))
        for at in range(0, first.size if second.size else 0, step):
            mine = first[at:at + step]
            near = possible(words[mine], sizes[mine].astype(np.int64), words[second], sizes[second].astype(np.int64))
            near &= root[mine][:, None] != root[second][None, :]
            x, y = np.nonzero(near)
            x, y = node[mine[x]], node[second[y]]
            found.append((np.minimum(x, y), np.maximum(x, y)))
        u, v = np.unique(np.stack([np.concatenate(f) for f in zip(*found)]), axis=1)
        return pa.table({"u": u, "v": v})

    return dealt.groupBy("band", "a", "b").applyInArrow(run, "u bigint, v bigint")


def _links(docs: DataFrame, nodes: DataFrame, few: int, block: int, scratch: Scratch) -> DataFrame:
    """(u, root) for every node that is not the least of its component; ``docs`` has one, two and text.

    ``nodes`` is the scratch table of that name, which is gone afterwards, as is every table but the result's.
    """
    bands = nodes.select("node", "shingles", F.explode("bands").alias("band")).unionByName(_print_bands(nodes, scratch))
    # Most bands have one member and are neither written nor joined on.
    shared = bands.groupBy("band").agg(F.min(F.struct("node", "shingles")).alias("first"), F.count("*").alias("_n")).filter("_n > 1")
    seats = scratch.written(bands.join(shared.select("band", F.col("first.node").alias("first"), F.col("first.shingles").alias("first_shingles")), "band"), "seats")
    candidates = nodes.select("one", "two", "node").join(seats.select("node").distinct(), "node", "left_semi")
    # Rows that are equal in all columns give one set.
    sets = scratch.written(_sets(docs.join(candidates, ["one", "two"]).select("node", "text")).dropDuplicates(["node"]), "sets")
    scratch.drop("nodes", "prints")
    tried = scratch.written(seats.filter("first < node").filter(_of_like_size("shingles", "first_shingles"))
                            .select(F.col("first").alias("u"), F.col("node").alias("v")).distinct(), "tried")
    linked = _confirmed(tried, sets, scratch, "linked")
    roots = scratch.written(components(linked), "roots")
    scratch.drop("linked")

    placed = scratch.written(seats.join(roots.withColumnRenamed("u", "node"), "node", "left")
                             .select("band", "node", "shingles", F.coalesce("root", "node").alias("root")), "placed")
    scratch.drop("seats")
    mixed = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("_n")).filter("low < high")
    some = scratch.written(placed.join(mixed.select("band", "_n"), "band"), "mixed")
    scratch.drop("placed")
    rest = (_pairs_of_few(some.filter(F.col("_n") <= few)).unionByName(_pairs_of_many(some.filter(F.col("_n") > few), sets, block))
            .distinct().join(tried, ["u", "v"], "left_anti"))
    more = _confirmed(scratch.written(rest, "rest"), sets, scratch, "more")
    scratch.drop("mixed", "rest", "tried", "sets")
    if more.isEmpty():
        return roots
    return components(more.unionByName(roots.select("u", F.col("root").alias("v"))))


def _row_names(docs: DataFrame) -> list[Column]:
    """``one`` and ``two``: 128 bits over all columns, nulls told apart, so that a row needs no number and no copy."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = [*columns, *(c.isNull() for c in columns)]
    return [F.xxhash64(*whole).alias("one"), F.xxhash64(F.lit("two"), *whole).alias("two")]


def one_of_each(docs: DataFrame, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """One row of ``docs`` of each group of near copies; see the module's text."""
    names = _row_names(docs)
    scratch = Scratch(docs.sparkSession, "near-copies")
    rows = scratch.written(_described(docs.select(*names, F.col("doc_id").cast("bigint").alias("doc_id"), "text")), "described")
    # The least row stands for all rows with its set. Its bands are moved, those of its copies end here.
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "one", "two", "shingles", "bands")
    # Texts with equal sets may repeat their shingles differently, and then have fingerprints of their own.
    least = rows.groupBy("digest").agg(F.min(row).alias("x"), F.collect_set("fp").alias("prints")).select(
        "x.*", "prints").withColumn("node", F.monotonically_increasing_id())
    nodes = scratch.written(least, "nodes")
    # Without the bands, which are not kept for longer than the links need them.
    narrow = scratch.written(nodes.select("no_id", "doc_id", "one", "two", "node"), "narrow")
    repeated = scratch.written(rows.groupBy("one", "two").agg(F.count("*").alias("n")).filter("n > 1").select("one", "two"), "repeated")
    scratch.drop("described")
    roots = _links(docs.select(*names, "text"), nodes, few, block, scratch)
    grouped = narrow.join(roots.withColumnRenamed("u", "node"), "node", "left")
    kept = scratch.written(grouped.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("no_id", "doc_id", "one", "two")).alias("x"))
                   .select("x.one", "x.two"), "kept")
    scratch.drop("narrow")
    whole = docs.select(*names, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"))
    chosen = whole.join(kept, ["one", "two"], "left_semi")
    if not repeated.isEmpty():
        # Rows that are equal in all columns: any one of them.
        again = whole.join(kept.join(repeated, ["one", "two"], "left_semi"), ["one", "two"], "left_semi")
        chosen = chosen.join(repeated, ["one", "two"], "left_anti").unionByName(
            again.groupBy("one", "two").agg(F.any_value("whole").alias("whole")))
    return chosen.select(*(F.col("whole")[c].alias(c) for c in docs.columns))
