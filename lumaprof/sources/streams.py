"""Binary sample streams: header plus size-prefixed records.

A file is cut into blocks of bytes, wherever those fall. A task finds the records of
a block without knowing where its first one starts: every position that may be a
record points to the one its size leads to, and pointer doubling gives for each
position in the block's beginning where its chain leaves the block and how many
records that takes. The blocks of a file are then stitched: the exit of one is the
entry of the next, so only a few positions per block are left, and each range of
whole records is decoded by its own task. No task reads a whole file, and no step of
Python is taken per record.

A position may be a record if it has the stream's type and a size that holds its
fixed fields and ends inside of the file; the chain stops with an error that names
the byte where it meets another one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaprof.operators.reuse import cut
from lumaprof.sources.schemas import PMU_SAMPLE, SPE_SAMPLE

# --- fixed values: stream format ---------------------------------------------
MAGIC, HEADER_SIZE = b"MPSP", 40
HEADER = np.dtype([
    ("magic", "S4"), ("kind", "<u2"), ("major", "<u2"), ("minor", "<u2"), ("header_size", "<u2"), ("endian", "u1"),
    ("ts_unit", "u1"), ("reserved", "<u2"), ("records", "<u8"), ("first_ts", "<u8"), ("last_ts", "<u8")])
PMU_KIND, SPE_KIND = 1, 2
PMU_RECORD = np.dtype([
    ("type", "<u2"), ("size", "<u2"), ("flags", "<u4"), ("event_run_ref", "<u4"), ("event_key_ref", "<u4"),
    ("sample_kind", "<u2"), ("reserved", "<u2"), ("pid", "<u4"), ("tid", "<u4"), ("cpu", "<u4"), ("mapping_id", "<u8"),
    ("timestamp_ns", "<u8"), ("ip", "<u8"), ("period", "<u8"), ("n", "<u2")])
SPE_RECORD = np.dtype([
    ("type", "<u2"), ("size", "<u2"), ("flags", "<u4"), ("event_run_ref", "<u4"), ("pid", "<u4"), ("tid", "<u4"),
    ("cpu", "<u4"), ("mapping_id", "<u8"), ("timestamp_ns", "<u8"), ("ip", "<u8"), ("latency", "<u4"),
    ("operation_flags", "<u4"), ("event_flags", "<u8"), ("cache_level", "u1"), ("cache_result", "u1"),
    ("branch_result", "u1"), ("data_source", "<u2"), ("decode_status", "<u2"), ("raw_packet_offset", "<u8")])
NO_LATENCY = 0xFFFFFFFF

RANGE_BYTES = 32 << 20
#: Bytes that a 16-bit record size can reach.
LONGEST = 1 << 16
BATCH_RECORDS = 1 << 16


def _open(path: str):
    from pyarrow import fs

    uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path
    system, name = fs.FileSystem.from_uri(uri)
    return system.open_input_file(name)


def _header(head: bytes, kind: int, path: str) -> np.void:
    if len(head) < HEADER_SIZE or head[:4] != MAGIC:
        raise ValueError(f"{path}: not a sample stream")
    header = np.frombuffer(head, HEADER, 1)[0]
    if header["kind"] != kind:
        raise ValueError(f"{path}: stream kind {header['kind']}, expected {kind}")
    if header["endian"] != 1 or header["ts_unit"] != 1 or header["header_size"] < HEADER_SIZE:
        raise ValueError(f"{path}: unsupported stream header")
    return header


def _headers(kind: int):
    """(path, base, length, records) of each file; ``records`` is -1 where the stream ends with the file."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                with _open(path) as file:
                    length = file.size()
                    header = _header(file.read(HEADER_SIZE), kind, path)
                # Counter streams end with the announced record count, sampling streams with the file.
                rows.append((path, int(header["header_size"]), length, int(header["records"]) if kind == PMU_KIND else -1))
            yield pa.RecordBatch.from_pydict(dict(zip(("path", "base", "length", "records"), map(list, zip(*rows)))),
                                             schema=pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("base", "length", "records"))]))

    return read


def _word(data: np.ndarray, at: int, count: int) -> np.ndarray:
    """The 16-bit numbers that start ``at`` bytes behind each of the first ``count`` positions."""
    return data[at:at + count].astype(np.int32) | (data[at + 1:at + 1 + count].astype(np.int32) << 8)


class Chain:
    """The positions of a block that may be records, and which record follows which."""

    def __init__(self, raw: bytes, size: int, room: int, kind: int):
        """``raw`` is the block of ``size`` bytes and what follows of a record's fixed fields; ``room`` bytes are left in the file."""
        record = PMU_RECORD if kind == PMU_KIND else SPE_RECORD
        data = np.frombuffer(raw + bytes(max(0, size + record.itemsize + 1 - len(raw))), np.uint8)
        sizes = _word(data, 2, size)
        fits = (_word(data, 0, size) == kind) & (sizes >= record.itemsize) & (np.arange(size) + sizes <= room)
        if kind == PMU_KIND:
            fits &= sizes >= record.itemsize + 8 * _word(data, record.itemsize - 2, size)
        self.at = np.flatnonzero(fits)
        self.ends = self.at + sizes[self.at]
        follower = np.searchsorted(self.at, self.ends)
        inside = follower < self.at.size
        inside[inside] = self.at[follower[inside]] == self.ends[inside]
        # The last record of a chain points to itself.
        self.jumps = [np.where(inside, follower, np.arange(self.at.size))]
        steps = inside.astype(np.int64)
        while inside.any():
            jump = self.jumps[-1]
            steps = steps + steps[jump]
            if (jump[jump] == jump).all():
                break
            self.jumps.append(jump[jump])
        self.exits, self.counts = self.ends[self.jumps[-1]], steps + 1

    def from_entry(self, entry: int) -> np.ndarray:
        """All record positions of the chain that starts at ``entry``, in order."""
        first = np.searchsorted(self.at, entry)
        reached = np.array([first]) if first < self.at.size and self.at[first] == entry else np.empty(0, np.int64)
        for jump in self.jumps if reached.size else []:
            reached = np.unique(np.concatenate([reached, jump[reached]]))
        return self.at[reached]


def _block(path: str, start: int, size: int) -> tuple[bytes, int]:
    with _open(path) as file:
        length = file.size()
        file.seek(start)
        return file.read(min(size + 128, length - start)), length - start


def _framed(kind: int):
    """(path, block, entry, exit, count) for every position at which a chain may enter a block, in bytes of the file."""
    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block, start, size in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "start", "size"))):
                raw, room = _block(path, start, size)
                chain = Chain(raw, size, room, kind)
                # A record has 64 KB at most, so a chain enters there; into the first block at its beginning.
                enters = chain.at < (1 if block == 0 else LONGEST)
                count = int(enters.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * count, pa.string()), pa.array([block] * count, pa.int64()), pa.array(start + chain.at[enters], pa.int64()),
                     pa.array(start + chain.exits[enters], pa.int64()), pa.array(chain.counts[enters], pa.int64())],
                    ["path", "block", "entry", "exit", "count"])

    return frame


def _stitch(rows: pa.Table) -> pa.Table:
    """Follows the blocks of one file from entry to exit: ranges of whole records, and the byte where the chain breaks."""
    def first(column: str) -> int:
        return next(v for v in rows.column(column).to_pylist() if v is not None)

    path, at, length, left = rows.column("path")[0].as_py(), first("base"), first("length"), first("records")
    steps = {e: (x, c) for e, x, c in zip(*(rows.column(n).to_pylist() for n in ("entry", "exit", "count"))) if e is not None}
    found = []
    while left > 0 if left >= 0 else at < length:
        if at not in steps:
            found.append((path, at, at, 0, "truncated record" if at >= length else "bad record"))
            break
        end, count = steps[at]
        take = count if left < 0 else min(count, left)
        found.append((path, at, end, take, None))
        at, left = end, left - take if left >= 0 else left
    names = ("path", "start", "stop", "records", "problem")
    return pa.Table.from_pylist([dict(zip(names, f)) for f in found], schema=pa.schema(
        [("path", pa.string()), *((n, pa.int64()) for n in names[1:4]), ("problem", pa.string())]))


def _ranges(spark: SparkSession, paths: str | list[str], kind: int, range_bytes: int) -> DataFrame:
    """(path, start, stop, records, problem): ranges of whole records of all files, and where files break."""
    files = spark.read.format("binaryFile").load(paths).select("path")
    heads = cut(files.repartition("path").mapInArrow(_headers(kind), "path string, base long, length long, records long"))
    size = F.lit(range_bytes).cast("bigint")
    blocks = heads.withColumn("block", F.explode(F.expr(f"sequence(0L, greatest(length - base - 1, 0L) div {range_bytes}L)"))).withColumn(
        "start", F.col("base") + F.col("block") * size).select("path", "block", "start", F.least(size, F.col("length") - F.col("start")).alias("size"))
    framed = cut(blocks.repartition("path", "block").mapInArrow(_framed(kind), "path string, block long, entry long, exit long, count long"))
    exits = framed.select("path", F.col("exit").alias("entry")).distinct()
    reached = framed.filter("block > 0").join(exits, ["path", "entry"], "left_semi").unionByName(framed.filter("block = 0"))
    whole = heads.unionByName(reached.select("path", "entry", "exit", "count"), allowMissingColumns=True)
    # A few rows per block of a file.
    return cut(whole.groupBy("path").applyInArrow(_stitch, "path string, start long, stop long, records long, problem string"))


def _gather(data: np.ndarray, starts: np.ndarray, record: np.dtype) -> np.ndarray:
    return data[starts[:, None] + np.arange(record.itemsize)].copy().view(record).ravel()


def _signed(values: np.ndarray) -> pa.Array:
    # Unsigned 64-bit fields keep their bits in signed longs.
    return pa.array(np.ascontiguousarray(values).astype("<u8").view("<i8"))


def _pmu_batch(data: np.ndarray, starts: np.ndarray) -> dict[str, pa.Array]:
    rows = _gather(data, starts, PMU_RECORD)
    counts = rows["n"].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(counts)])
    inside = np.arange(ends[-1]) - np.repeat(ends[:-1], counts)
    at = np.repeat(starts + PMU_RECORD.itemsize, counts) + inside * 8
    ips = data[at[:, None] + np.arange(8)].copy().view("<u8").ravel() if len(at) else np.empty(0, "<u8")
    chains = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(ips))
    columns = {name: _signed(rows[name]) for name in
               ("flags", "event_run_ref", "event_key_ref", "pid", "tid", "cpu", "mapping_id", "timestamp_ns", "ip", "period")}
    return columns | {"sample_kind": pa.array(rows["sample_kind"].astype("i4")), "callchain": chains}


def _spe_batch(data: np.ndarray, starts: np.ndarray) -> dict[str, pa.Array]:
    rows = _gather(data, starts, SPE_RECORD)
    columns = {name: _signed(rows[name]) for name in
               ("flags", "event_run_ref", "pid", "tid", "cpu", "mapping_id", "timestamp_ns", "ip", "operation_flags",
                "event_flags", "raw_packet_offset")}
    small = {name: pa.array(rows[name].astype("i4")) for name in
             ("cache_level", "cache_result", "branch_result", "data_source", "decode_status")}
    latency = pa.array(rows["latency"].astype("i8"), mask=rows["latency"] == NO_LATENCY)
    return columns | small | {"latency": latency}


def _decode(batch_of, kind: int, names: list[str], schema: pa.Schema):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop, records, problem in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "stop", "records", "problem"))):
                if problem:
                    raise ValueError(f"{path}: {problem} at byte {start}")
                raw, room = _block(path, start, stop - start)
                starts = Chain(raw, stop - start, room, kind).from_entry(0)[:records]
                data = np.frombuffer(raw, np.uint8)
                for low in range(0, len(starts), BATCH_RECORDS):
                    part = starts[low:low + BATCH_RECORDS]
                    columns = batch_of(data, part) | {"path": pa.array([path] * len(part))}
                    yield pa.RecordBatch.from_arrays([columns[n] for n in names], schema=schema)

    return decode


def _read(spark: SparkSession, paths: str | list[str], kind: int, ddl: str, batch_of, range_bytes: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(ddl)
    ranges = _ranges(spark, paths, kind, range_bytes)
    return ranges.repartition("path", "start").mapInArrow(_decode(batch_of, kind, schema.names, to_arrow_schema(schema)), ddl)


def stream_problems(spark: SparkSession, paths: str | list[str], kind: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(path, offset, problem)`` of the files whose records break off, at the first byte that is no record."""
    return _ranges(spark, paths, kind, range_bytes).filter("problem is not null").select("path", F.col("start").alias("offset"), "problem")


def read_pmu(spark: SparkSession, paths: str | list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Counter samples of all files; latency-free records with a caller chain."""
    return _read(spark, paths, PMU_KIND, PMU_SAMPLE, _pmu_batch, range_bytes)


def read_spe(spark: SparkSession, paths: str | list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Instruction samples of all files; the all-ones latency is null."""
    return _read(spark, paths, SPE_KIND, SPE_SAMPLE, _spe_batch, range_bytes)


def record_file_problems(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Record files that cannot be a recording: empty, or a first 64 bytes that are all zero.

    Takes the file names themselves, since a directory scan leaves empty files out.
    """
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                with _open(path) as file:
                    head = file.read(64)
                problem = "empty" if not head else "zeroed header" if head == bytes(64) else None
                if problem:
                    found.append((path, problem))
            yield pa.RecordBatch.from_pydict(
                {"path": [f[0] for f in found], "problem": [f[1] for f in found]},
                schema=pa.schema([("path", pa.string()), ("problem", pa.string())]))

    files = spark.createDataFrame([(path,) for path in paths], "path string")
    return files.repartition("path").mapInArrow(check, "path string, problem string")


def meta_info(sections: DataFrame, keys: list[str], column: str = "data") -> DataFrame:
    """NUL-separated ``key, value, ...`` bytes to pairs; an odd tail is dropped and the last duplicate wins."""
    items = F.split(F.decode(column, "UTF-8"), "\u0000")
    # The text after the last NUL is not terminated and does not count.
    rows = sections.select(*keys, items.alias("_items"))
    count = F.floor((F.size("_items") - 1) / 2).cast("int")
    indexes = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    pairs = rows.select(*keys, "_items", F.explode(indexes).alias("_i")).select(
        *keys, "_i", F.get("_items", F.col("_i") * 2).alias("key"), F.get("_items", F.col("_i") * 2 + 1).alias("value"))
    return pairs.groupBy(*keys, "key").agg(F.max_by("value", "_i").alias("value"))
