"""A two-dimensional layout that keeps neighbours: points are drawn to their nearest rows and pushed from all others.

The neighbour graph comes from an inverted-file index, the first positions from principal components. Each round reads the
positions that the round before wrote: a row hands its place to those that it draws, in lists that are made once, and a grid of GRID x GRID cells,
whose counts and centres are all that leaves the tasks, stands for what pushes it. Positions are the same on every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import nearest
from millrace.operators.clusters import principal_layout
from millrace.operators.rounds import written

GRID = 48  # cells a side: a few thousand rows at most reach the driver
LIST = 4096  # rows of a neighbour list, in the mean: a row that draws more has several
ROWS = 64  # points that meet the grid at once: their distances stay in a core's cache


def _started(points: DataFrame, id_col: str, embedding: str) -> DataFrame:
    """Principal components with a spread of ten."""
    first = principal_layout(points, embedding, id_col).select(F.col(id_col).alias("id"), F.col("p0").alias("x"), F.col("p1").alias("y"))
    spread = first.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.greatest(F.stddev_pop("x"), F.stddev_pop("y")).alias("s")).first()
    scale = 10 / spread["s"] if spread["s"] else 0.0
    return first.select("id", ((F.col("x") - spread["mx"]) * scale).alias("x"), ((F.col("y") - spread["my"]) * scale).alias("y"))


def _push(cells: np.ndarray, x: Column, y: Column, rate: float) -> Column:
    """Sum over cells (n, x, y) of what pushes a point away, falling with the fourth power of the distance; the own place of a point pushes nothing."""

    @F.arrow_udf(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
    def push(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        n, cx, cy = cells.T
        for xs, ys in batches:
            out = np.zeros((len(xs), 2))
            px, py = xs.to_numpy(zero_copy_only=False), ys.to_numpy(zero_copy_only=False)
            for at in range(0, len(px), ROWS):
                dx, dy = px[at : at + ROWS, None] - cx, py[at : at + ROWS, None] - cy
                d2 = dx * dx + dy * dy
                force = rate * n / ((0.1 + d2) * (1 + d2))
                out[at : at + ROWS] = np.stack([(force * dx).sum(1), (force * dy).sum(1)], 1)
            yield pa.StructArray.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["x", "y"])

    return push(x, y)


def _lists(graph: DataFrame) -> DataFrame:
    """(b, near) of a graph (a, b): the rows that b draws, so that a round joins a row a point and shuffles edges once."""
    drawn = F.ceil(F.count(F.lit(1)) / LIST).alias("parts")
    dealt = graph.join(graph.groupBy("b").agg(drawn), "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")))
    return dealt.groupBy("b", "part").agg(F.array_sort(F.collect_list("a")).alias("near")).select("b", "near")


def neighbour_layout(points: DataFrame, id_col: str = "id", embedding: str = "embedding", neighbours: int = 10, rounds: int = 24, probes: int = 16, push: float = 5.0) -> DataFrame:
    """(id, x, y) of every point with a vector."""
    points = points.where(F.col(embedding).isNotNull())
    index = nearest.build(points, id_col, embedding)
    if index is None:
        return points.sparkSession.createDataFrame([], "id long, x double, y double")
    near = nearest.search(index, index.rows.select("id", "v"), neighbours, probes, others_only=True)
    one = near.select(F.col("query").alias("a"), F.col("id").alias("b"))
    graph = written(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "graph")
    lists = written(_lists(graph), "lists")
    at = written(_started(points, id_col, embedding), "layout")
    for k in range(rounds):
        rate = 1.0 - k / rounds
        bounds = at.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        cell = lambda c, low, high: F.floor((F.col(c) - low) / ((high - low) or 1.0) * (GRID - 1e-6))
        cells = at.groupBy(cell("x", bounds[0], bounds[1]), cell("y", bounds[2], bounds[3])).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y")).select("n", "x", "y")
        table = np.array(sorted(tuple(map(float, r)) for r in cells.collect())).reshape(-1, 3)
        other, own = at.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by")), at.select(F.col("id").alias("a"), "x", "y")
        pairs = lists.join(other, "b").select(F.explode("near").alias("a"), "bx", "by").join(own, "a")
        dx, dy = F.col("bx") - F.col("x"), F.col("by") - F.col("y")
        pull = 1 / (1 + dx * dx + dy * dy)
        drawn = pairs.groupBy("a").agg(F.sum(pull * dx).alias("px"), F.sum(pull * dy).alias("py")).withColumnRenamed("a", "id")
        moved = at.join(drawn, "id", "left").withColumn("push", _push(table, F.col("x"), F.col("y"), push / index.n * neighbours))
        step = lambda c, p: F.col(c) + rate * F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.coalesce(p, F.lit(0.0)) + F.col(f"push.{c}")))
        at = written(moved.select("id", step("x", "px").alias("x"), step("y", "py").alias("y")), "layout")
    return at


def placed(index: nearest.Index, layout: DataFrame, new: DataFrame, neighbours: int = 5, probes: int = 16) -> DataFrame:
    """(id, x, y) of new points (id, v) in a finished layout: the mean of their nearest rows there, nearer ones counting more."""
    near = nearest.search(index, new, neighbours, probes)
    weight = 1 / (F.col("distance") + 1e-9)
    at = near.join(layout, "id").withColumn("w", weight)
    return at.groupBy(F.col("query").alias("id")).agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("y"))


def kept(points: DataFrame, layout: DataFrame, asked: Column, k: int = 10, id_col: str = "id", embedding: str = "embedding") -> DataFrame:
    """(wanted, hit): of the k nearest rows of the asked points, how many are among their k nearest in the layout. Exact on both sides."""
    high = nearest.build(points, id_col, embedding)
    low = nearest.build(layout.select("id", F.array("x", "y").alias("at")), "id", "at")
    of = lambda index: nearest.search(index, index.rows.where(asked).select("id", "v"), k, len(index.centers), others_only=True)
    return nearest.recall(of(low), of(high))
