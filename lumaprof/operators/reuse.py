"""Results that several later steps read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


_HELD: list[DataFrame] = []


def kept(rows: DataFrame) -> DataFrame:
    """Computed once and spilled if needed; recomputed from its lineage if an executor is lost.

    Held until ``release``; a result that still refers to it afterwards is computed again.
    """
    _HELD.append(rows.persist(StorageLevel.MEMORY_AND_DISK))
    return _HELD[-1]


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where it names none, on a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lumaprof-"))
    return context.getCheckpointDir()


def cut(rows: DataFrame) -> DataFrame:
    """Computed at once and written to the shared folder: plans on top of it neither hold nor print its own.

    For results that results are built of in turn: nested persisted plans are walked
    once per reference at every adaptive step, which costs the driver more than the
    work. A compressed table in columns, so that a later step reads only those it asks
    for; a checkpoint holds whole rows as they lie in memory.
    """
    return Scratch(rows.sparkSession, "cut").written(rows, "rows")


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is made and run in here go when it has run, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Scratch:
    """Tables of one run in the shared folder, deleted by name once no later step reads them.

    For rounds of narrow rows, where every round replaces the one before: a table is
    compressed, and only the last ones lie on disk.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def written(self, rows: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with _shuffles_removed(self.spark):
            # What was made before keeps its shuffles, so the same rows are asked for anew.
            rows.select("*").write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Only after all that is made of these tables has been written itself."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> int:
    """Give up everything kept so far; returns how many results that were."""
    count = len(_HELD)
    while _HELD:
        _HELD.pop().unpersist()
    return count
