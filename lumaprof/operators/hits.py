"""Hit counts on source context lines and on disassembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaprof.operators.lookup import latest_before

CONTEXT = 5


def context_lines(hits: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Existing source lines within five of a hit, with counts on the hit lines.

    ``hits`` is ``(keys, file, line, self, subtree)``; hits on one line are
    summed before the window around them is opened, so the fan-out is 11 per line.
    """
    summed = hits.groupBy(*keys, "file", "line").agg(F.sum("self").alias("self"), F.sum("subtree").alias("subtree"))
    around = summed.select(*keys, "file", F.col("line").alias("_hit"), "self", "subtree", F.explode(
        F.sequence(F.col("line") - CONTEXT, F.col("line") + CONTEXT)).alias("line"))
    on_line = F.col("line") == F.col("_hit")
    shown = around.groupBy(*keys, "file", "line").agg(
        F.sum(F.when(on_line, F.col("self")).otherwise(0)).alias("self"),
        F.sum(F.when(on_line, F.col("subtree")).otherwise(0)).alias("subtree"))
    rows = shown.join(source.select("file", "line", "code"), ["file", "line"])
    # A file is listed only when one of its existing lines was hit.
    listed = summed.join(source.select("file", "line"), ["file", "line"], "left_semi").select(*keys, "file").distinct()
    return rows.join(listed, [*keys, "file"], "left_semi")


def annotated_disassembly(hits: DataFrame, code: DataFrame, keys: list[str]) -> DataFrame:
    """Disassembly lines with the counts of the hits up to the next addressed line.

    ``hits`` is ``(keys, address, self, subtree)``, ``code`` is ``(keys, pos, address, text)``
    with address 0 on lines that have none. A hit belongs to the last addressed line
    at or before it.
    """
    addressed = code.filter("address <> 0").groupBy(*keys, "address").agg(F.max("pos").alias("pos"))
    hit_rows = hits.withColumnRenamed("address", "address_hit")
    placed = latest_before(hit_rows, addressed, keys, "address_hit", "address", ["pos"]).filter("pos is not null")
    counts = (
        hit_rows.join(placed, [*keys, "address_hit"])
        .groupBy(*keys, "pos").agg(F.sum("self").alias("self"), F.sum("subtree").alias("subtree")))
    return code.join(counts, [*keys, "pos"], "left").withColumn("self", F.coalesce("self", F.lit(0))).withColumn(
        "subtree", F.coalesce("subtree", F.lit(0)))
