"""Source files: discovery, numbered lines, and disassembly listings."""

from __future__ import annotations

import posixpath
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaprof.functions import classify as C
from lumaprof.functions import paths as P


def _plain(path):
    return F.regexp_replace(path, "^file:/+", "/")


def _file_path():
    """The file a row was read from; the metadata column percent-encodes it and leaves ``+`` as it is."""
    return _plain(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))


def discover(spark: SparkSession, roots: list[str], skip: bool = True) -> DataFrame:
    """Distinct source file paths under the roots, which may be directories or files.

    A root that is a file is always taken; directories and directory roots with a
    skipped name, and roots in the engine's own source, are not searched.
    ``skip=False`` is the workbook's variant: no directory and no root is skipped.
    """
    found = []
    for root in (posixpath.normpath(r) for r in roots):
        searched = not skip or not (P.SKIPPED_ROOT_PART in root.replace("\\", "/") or P.is_skipped_name(posixpath.basename(root)))
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        path, whole = _plain(F.col("path")), re.sub("^file:/+", "/", root)
        inner = F.substr(path, F.lit(len(whole.rstrip("/")) + 2))
        below = F.lit(searched) if not skip else F.lit(searched) & ~P.in_skipped_directory(F.col("_inner"))
        found.append(listing.select(path.alias("path"), inner.alias("_inner")).filter(P.is_source_file(F.col("path")))
                     .filter((F.col("path") == whole) | below))
    if not found:
        return spark.createDataFrame([], "path string")
    return reduce(DataFrame.unionByName, found).select("path").distinct()


def numbered_lines(files: DataFrame, file: str, text: str) -> DataFrame:
    """``(file, line, code)`` from whole texts: ``\\n`` or ``\\r\\n`` ends a line, no line after the last one."""
    body = F.regexp_replace(F.col(text), r"\r?\n\z", "")
    lines = F.split(body, r"\r?\n")
    return files.filter(F.col(text) != "").select(F.col(file).alias("file"), F.posexplode(lines).alias("_i", "code")).select(
        "file", (F.col("_i") + 1).alias("line"), "code")


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Numbered lines of source files on storage; a source file fits in a row."""
    raw = spark.read.text(paths, wholetext=True).select(_file_path().alias("path"), "value")
    return numbered_lines(raw, "path", "value")


def disassembly(lines: DataFrame, keys: list[str], text: str = "text", order: str = "pos") -> DataFrame:
    """``addr: code... mnemonic operands`` lines; the last line of an address wins.

    Machine code tokens are all-hex with at least one digit, so a mnemonic such as ``add`` is none.
    """
    raw = F.col(text)
    address = F.trim(F.regexp_extract(raw, r"^\s*([^:]*):", 1))
    rest = F.regexp_extract(raw, r"^[^:]*:\s*(.*)$", 1)
    code = F.regexp_replace(rest, r"^(?:(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]+(?:\s+|$))*", "")
    words = F.split(F.trim(F.regexp_replace(code, r"\s+", " ")), " ", 2)
    parsed = lines.filter(address.rlike("^[0-9a-fA-F]{1,16}$")).select(
        *keys, F.col(order).alias("_order"), F.conv(address, 16, -10).cast("bigint").alias("address"),
        words[0].alias("mnemonic"), F.coalesce(F.get(words, F.lit(1)), F.lit("")).alias("operands"), raw.alias("raw"))
    row = F.struct("mnemonic", "operands", "raw")
    last = parsed.filter("mnemonic <> ''").groupBy(*keys, "address").agg(F.max_by(row, "_order").alias("r")).select(
        *keys, "address", "r.*")
    return last.withColumn("class", C.mnemonic_class(F.col("mnemonic"), F.col("operands"))).withColumn(
        "kind", C.mnemonic_load_kind(F.col("mnemonic"), F.col("operands")))


def read_disassembly(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Disassembly listings on storage, split as text: line order is (block start, position in the block)."""
    raw = spark.read.text(paths).select(
        _file_path().alias("path"), F.col("value").alias("text"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("pos"))
    return disassembly(raw, ["path"])
