"""Connected components by alternating large and small stars, each round written to the shared folder.

Edges are pairs of longs; no edge list or component leaves the executors. Hot vertices are looked up by broadcast of at
most HOT_SHARE rows (common.lookup), minima are aggregated before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import lookup, materialize, release


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _star(edges: DataFrame, total: int, large: bool) -> DataFrame:
    """edges (u, v). Large: every larger neighbour of u goes to u's least neighbour. Small: every smaller one, and u."""
    if large:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("members"))
    met = lookup(edges, "u", least, 2 * total).select("u", "v", F.least("u", "m").alias("m"))
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return materialize(out.where("u > v").distinct(), "stars")


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each vertex that isn't the least of its component, with that least vertex. edges: u, v of any order."""
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    before = _fingerprint(edges)
    while before[0]:
        large = _star(edges, before[0], True)
        small = _star(large, before[0], False)
        release(edges, large)
        edges = small
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    return edges
