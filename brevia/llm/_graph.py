"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ._stage import saved


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long) but the smallest of each component.

    ``component`` is the smallest node reachable. Each step is two aggregations with partial sums and two joins on
    node ids, written to the shared folder. A hub's neighbours are never gathered in one row, and the join that gives them
    their least node reads both sides from plain shuffles, so adaptive execution splits a hub's rows over tasks. Loops and
    repeated edges are allowed; null ends are ignored.
    """
    ends = [F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")]
    state, mark = _written(edges.where("a is not null and b is not null and a <> b").select(*ends).distinct(), name)
    while mark[0]:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state, now = _written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name)
        if now == mark:
            break
        mark = now
    return state.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _written(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The written edges, and their number and a check sum, which are taken while they are written."""
    seen = Observation()
    out = saved(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("mark")), name)
    return out, (seen.get["n"], seen.get["mark"])
