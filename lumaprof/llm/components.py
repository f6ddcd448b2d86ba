"""Connected components of a graph given as an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaprof.llm.common import join_by_share, written


def _towards_least(edges: DataFrame, label: str) -> DataFrame:
    """Each edge (u, v) with the least of u and all its neighbours, as (u, v, least)."""
    least = written(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"), F.count("*").alias("_n")), label)
    return join_by_share(edges, least, "u", "_n")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, root) for every node that is not itself the least of its component.

    ``edges`` has columns u and v of one orderable type, in any direction; loops and
    repeated edges do no harm. Every round is a large and a small star step over the
    whole edge table, each written to the shared folder. Hubs are joined by
    broadcasting the few that hold a large share of the edges, so no node's edges
    meet in one task. Raises if the graph has not settled after ``rounds`` rounds.
    """
    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_towards_least(both, "large").filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
                        .filter("u <> v").distinct(), "edges")
        small = _towards_least(large, "small")
        now = written(small.select(F.col("v").alias("u"), F.col("least").alias("v"))
                      .unionByName(small.select("u", F.col("least").alias("v")))
                      .filter("u <> v").distinct(), "edges")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if state == before:
            return now.select("u", F.col("v").alias("root"))
        before = state
    raise RuntimeError(f"components have not settled after {rounds} rounds")
