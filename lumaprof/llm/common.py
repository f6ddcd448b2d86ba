"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join key is hot from this share of all rows on, so at most ``1 / HOT_SHARE`` keys can be hot.
HOT_SHARE = 0.001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's checkpoint folder, or one of our own where a local master names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="llm-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(rows: DataFrame, label: str, options: dict[str, str] | None = None, path: str | None = None) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there and a lost executor loses nothing."""
    path = path or shared_path(rows.sparkSession, label)
    rows.write.options(**options or {}).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that no later step reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class Scratch:
    """Tables of one run in the shared folder, deleted by name once no later step reads them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.live = spark, shared_path(spark, label), set()

    def written(self, rows: DataFrame, name: str) -> DataFrame:
        self.live.add(name)
        return written(rows, name, path=f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Only after all that is made of these tables has been written itself."""
        for name in names:
            self.live.remove(name)
            removed(self.spark, f"{self.root}/{name}")


def text_bytes(column: str | Column) -> Column:
    """UTF-8 bytes of a text, a null one being empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about ``most`` bytes of one text column (a row is never cut)."""
    sizes = [0 if v is None else v for v in pc.binary_length(batch.column(column)).to_pylist()]
    start, held = 0, 0
    for at, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def join_by_share(rows: DataFrame, keyed: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of ``rows`` with one row per key, safe where a key holds a large share of the rows.

    ``keyed`` has a column ``count``: how many of the rows have this key. Keys with
    at least ``HOT_SHARE`` of them (a thousand at most) are broadcast; all others
    meet in a shuffle, where no key has more than that share.
    """
    total = keyed.agg((F.sum(count) * HOT_SHARE).alias("_least"))
    least = total.first()["_least"]
    if least is None:
        return rows.join(keyed.drop(count), key)
    hot = keyed.filter(F.col(count) >= F.lit(float(least))).drop(count)
    rest = keyed.filter(F.col(count) < F.lit(float(least))).drop(count)
    payload = [c for c in keyed.columns if c not in (key, count)]
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    done = marked.filter("_hot").select(*rows.columns, *payload)
    open_rows = marked.filter("_hot is null").select(*rows.columns)
    return done.unionByName(open_rows.join(rest, key).select(*rows.columns, *payload))
