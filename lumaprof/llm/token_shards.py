"""Token sequences in training order, as binary shards of fixed stride.

Each task cuts its documents' token stream (an end id after each) into sequences of
equal length. A keyed Feistel permutation with cycle-walking then gives every
sequence a slot of its own in the training order: it permutes the next power of
four, and a number that falls outside the sequences walks on until it is inside. So
the order is fixed by the key and the count alone, and any slot can be computed
without a table. Ranges of slots become shards, written by Spark's own writer and
committed per task; record n of a shard starts at n times the stride, so reading is
sequential and resumes at any slot.

A record is the sequence's ids as little-endian unsigned 16-bit integers and one
line feed that the writer adds. The last sequence of a task is filled up with the
end id.

Null texts count as empty; null ids and repeated rows are tokenised like any other,
and long texts whole, over as many sequences as they need.
An empty table gives no shard and no row. Only the text is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumaprof.llm.common import shared_path, slices, written
from lumaprof.llm.word_ids import word_ids

#: Ids of a sequence, sequences of a shard (8 MB), and Feistel rounds.
SEQUENCE, SHARD_SEQUENCES, ROUNDS = 1024, 4096, 6
#: How the sequences are kept until they have their slots: they are written and read once.
STAGED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6"}


def sequences(docs: DataFrame, tokenizer_path: str, length: int = SEQUENCE, end_id: int = 2) -> DataFrame:
    """(task, local, ids): the token stream of each task in sequences of ``length`` ids."""
    end = end_id.to_bytes(2, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, local = word_ids(tokenizer_path), TaskContext.get().partitionId(), 0
        rest = b""

        def rows(stream: bytes, count: int) -> pa.RecordBatch:
            cut = [stream[2 * length * n:2 * length * (n + 1)] for n in range(count)]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(count, task, np.int32)), pa.array(np.arange(local, local + count)), pa.array(cut, pa.binary())],
                ["task", "local", "ids"])

        for batch in batches:
            for part in slices(batch, "text"):
                found = [rest]
                for whole in words.encode_all(part.column("text")):
                    ids = np.frombuffer(whole, "<u4")
                    if ids.size and ids.max() > 0xFFFF:
                        raise ValueError("an id needs more than 16 bits")
                    found += [ids.astype("<u2").tobytes(), end]
                stream = b"".join(found)
                count = len(stream) // (2 * length)
                if count:
                    yield rows(stream, count)
                    local += count
                rest = stream[2 * length * count:]
        if rest:
            yield rows(rest + end * (length - len(rest) // 2), 1)

    return docs.select("text").mapInArrow(run, "task int, local bigint, ids binary")


def permuted(numbers: np.ndarray, count: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """The slot of each number below ``count``: a bijection fixed by ``key``."""
    half = np.uint64(max(1, -(-max(count - 1, 1).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = np.random.Generator(np.random.PCG64(key)).integers(1, 1 << 63, rounds, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((mixed >> np.uint64(29)) & mask)
        return left << half | right

    slots = once(numbers.astype(np.uint64))
    while (outside := slots >= np.uint64(count)).any():
        slots[outside] = once(slots[outside])
    return slots.astype(np.int64)


def materialised(docs: DataFrame, tokenizer_path: str, path: str, key: int = 20_240_601, length: int = SEQUENCE,
                 shard_sequences: int = SHARD_SEQUENCES, end_id: int = 2) -> int:
    """Write all shards below ``path`` as ``shard=N`` folders of one file each; returns the number of sequences."""
    cut = written(sequences(docs, tokenizer_path, length, end_id), "sequences", STAGED)
    counts = written(cut.groupBy("task").agg(F.count("*").alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    if not total:
        return 0
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # One row per task of the first step.
    first = counts.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))

    @F.pandas_udf("bigint")
    def slot(numbers: pd.Series) -> pd.Series:
        return pd.Series(permuted(numbers.to_numpy(), total, key))

    placed = cut.join(F.broadcast(first), "task").select(slot(F.col("_first") + F.col("local")).alias("slot"), "ids")
    placed = placed.withColumn("shard", F.expr(f"cast(slot div {shard_sequences} as int)"))
    shards = -(-total // shard_sequences)
    (placed.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "slot")
     .select("shard", F.col("ids").cast("string").alias("value")).write.partitionBy("shard").text(path))
    return total


def read(spark: SparkSession, path: str, length: int = SEQUENCE, shard_sequences: int = SHARD_SEQUENCES, from_slot: int = 0) -> DataFrame:
    """(slot, shard, byte_offset, ids) of the records from a slot on; earlier shards are not opened."""
    stride = 2 * length + 1
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    files = files.filter(F.col("shard") >= from_slot // shard_sequences)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content")):
                content = content.as_buffer()
                if content.size % stride:
                    raise ValueError(f"shard {shard} is cut off")
                places = [n for n in range(content.size // stride) if shard * shard_sequences + n >= from_slot]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard * shard_sequences + n for n in places], pa.int64()), pa.array([shard] * len(places), pa.int32()),
                     pa.array([n * stride for n in places], pa.int64()),
                     pa.array([content[n * stride:(n + 1) * stride - 1].to_pybytes() for n in places], pa.binary())],
                    ["slot", "shard", "byte_offset", "ids"])

    return files.select("shard", "content").mapInArrow(run, "slot bigint, shard int, byte_offset bigint, ids binary")


def ordered(docs: DataFrame, tokenizer_path: str, **options: int) -> DataFrame:
    """Materialises the shards in the shared folder and returns what reading them back gives, with checksums."""
    spark = docs.sparkSession
    path = shared_path(spark, "token-shards")
    sizes = {k: v for k, v in options.items() if k in ("length", "shard_sequences")}
    if not materialised(docs, tokenizer_path, path, **options):
        return spark.createDataFrame([], "slot bigint, shard int, byte_offset bigint, n_ids int, ids_crc32 bigint")
    return read(spark, path, **sizes).select(
        "slot", "shard", "byte_offset", F.expr("cast(octet_length(ids) div 2 as int)").alias("n_ids"), F.crc32("ids").alias("ids_crc32"))
