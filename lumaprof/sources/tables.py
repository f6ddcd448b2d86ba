"""Decoded callstack samples and the saved report tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT_TABLES = ("metadata", "source_lines", "files", "functions")


def callstack_samples(parts: Sequence[DataFrame]) -> DataFrame:
    """Decoded samples of several record files, with the leaf in front of its callers as ``frames``."""
    rows = reduce(DataFrame.unionByName, parts)
    return rows.withColumn("frames", F.concat(F.array("leaf"), "callchain")).drop("leaf", "callchain")


def read_callstacks(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return callstack_samples([spark.read.parquet(path) for path in paths])


def report_generation(spark: SparkSession, root: str) -> str:
    """Folder of the last report that was written whole."""
    last = spark.read.text(f"{root.rstrip('/')}/commits").agg(F.max("value")).first()[0]  # one name per report
    if last is None:
        raise ValueError(f"{root}: no report has been written whole")
    return f"{root.rstrip('/')}/{last}"


def read_report(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of one generation: a report written later does not mix with them."""
    base = report_generation(spark, root)
    return {name: spark.read.parquet(f"{base}/{name}") for name in REPORT_TABLES}
