"""Approximate nearest neighbours by an inverted-file index: coarse centroids, the rows of each in blocks, and probes.

The centroids are fitted on a bounded sample; every row is indexed. A query visits the cells whose centroids are nearest
and meets the rows of their blocks; block and query groups are bounded, so a crowded cell is shared by many tasks. With all
cells probed the search is exact. Distances are Euclidean; for cosine, index `unit` vectors: the order is the same, and the
cosine distance is half the square. Rows without a vector, or of another length than the first sampled one's, aren't indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.vectors import normalised
from millrace.operators.rounds import written

SAMPLE = 8192  # rows that the centroids are fitted on, the first by the hash of their id
MOST_CELLS = 1024
BLOCK = 2048  # rows of a cell that a task holds, in the mean, and queries that meet them at once
ASKED = 1 << 25  # bytes of query vectors that a task holds, in the mean


def unit(points: DataFrame, embedding: str = "embedding") -> DataFrame:
    return points.withColumn(embedding, normalised(F.col(embedding).cast("array<double>")))


@dataclass
class Index:
    """rows: (id, v, cell, block, ...); cells: (cell, blocks); centers: a row a cell, on the driver."""

    rows: DataFrame
    cells: DataFrame
    centers: np.ndarray
    n: int


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of equal length as a matrix."""
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def centroids(sample: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds from rows spread over the sample."""
    centers = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        label = squared(sample, centers).argmin(1)
        total = np.zeros_like(centers)
        np.add.at(total, label, sample)
        n = np.bincount(label, minlength=k)
        centers[n > 0] = total[n > 0] / n[n > 0][:, None]
    return centers


def nearest_cells(vector: Column, centers: np.ndarray, probes: int) -> Column:
    """The cells of the nearest centroids, nearest first."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def cells(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            d = squared(matrix(pa.chunked_array([b])), centers) if len(b) else np.zeros((0, len(centers)))
            near = np.argsort(d, axis=1, kind="stable")[:, :probes].astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.reshape(-1)))

    return cells(vector)


def build(points: DataFrame, id_col: str = "id", embedding: str = "embedding", cells: int | None = None, keep: tuple[str, ...] = ()) -> Index | None:
    """The index of all points with a vector; None if there are none. keep: further columns to hold beside the vectors."""
    rows = points.where(F.col(embedding).isNotNull()).select(F.col(id_col).alias("id"), F.col(embedding).cast("array<double>").alias("v"), *keep)
    sample = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    if not len(sample):
        return None
    size = len(sample["v"][0])
    rows = rows.where(F.size("v") == size)
    fitted = matrix(pa.chunked_array([sample["v"].combine_chunks().filter(pa.array([len(v) == size for v in sample["v"]]))]))
    n = rows.count()
    k = max(1, min(MOST_CELLS, len(fitted), cells or round(n**0.5 / 2)))
    centers = centroids(fitted, k)
    placed = rows.withColumn("cell", F.get(nearest_cells(F.col("v"), centers, 1), F.lit(0)))
    placed = written(placed, "cells")
    counts = written(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "blocks")
    dealt = placed.join(F.broadcast(counts), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    return Index(dealt, counts, centers, n)


def meet(index: Index, queries: DataFrame, probes: int, run, schema: str) -> DataFrame:
    """run(queries, rows), Arrow tables, for every group of queries and every block of the cells that they probe. queries: (id, v, ...)."""
    queries = queries.select(*(F.col(c).alias(c) for c in queries.columns))  # they may be rows of the index
    near = queries.withColumn("cell", F.explode(nearest_cells(F.col("v"), index.centers, min(probes, len(index.centers)))))
    size = 8 * index.centers.shape[1]
    groups = near.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) * size / ASKED).cast("int").alias("groups"))
    both = written(index.cells.join(groups, "cell"), "meetings")  # a row a cell
    asked = near.join(F.broadcast(both), "cell").withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("groups")).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "groups")
    rows = index.rows.join(F.broadcast(both.select("cell", "groups")), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    keys = ["cell", "block", "part"]

    def pieces(q: pa.Table, r: pa.Table) -> pa.Table:
        return pa.concat_tables([run(q.slice(at, BLOCK), r) for at in range(0, max(1, len(q)), BLOCK)])

    return asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(pieces, schema)


def search(index: Index, queries: DataFrame, k: int, probes: int, others_only: bool = False) -> DataFrame:
    """(query, id, distance, rank) of the k nearest rows of each query (id, v); others_only: not of itself, by id."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        q, ids = asked["id"].to_numpy(), rows["id"].to_numpy()
        if not len(q) or not len(ids):
            return pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        a, b = matrix(asked["v"]), matrix(rows["v"])
        d = squared(a, b)
        if others_only:
            d[q[:, None] == ids[None, :]] = np.inf
        m = min(k, len(ids))
        near = np.argpartition(d, m - 1, axis=1)[:, :m]
        at = np.repeat(np.arange(len(q)), m)
        flat = near.reshape(-1)
        real = np.isfinite(d[at, flat])
        at, flat = at[real], flat[real]
        exact = np.sqrt(((a[at] - b[flat]) ** 2).sum(1))
        return pa.table({"query": q[at], "id": ids[flat], "distance": exact})

    found = meet(index, queries, probes, run, "query long, id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(wanted, hit): exact neighbours, and those that were found."""
    both = exact.select("query", "id").join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    return both.agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("hit"))


def tuned(index: Index, k: int, least: float = 0.95, queries: int = 64) -> int:
    """Probes, doubled until enough of the true neighbours of a bounded number of stored rows, the first by the hash of their id, are found."""
    asked = written(index.rows.select("id", "v").orderBy(F.xxhash64("id", F.lit(2)), "id").limit(queries), "tuning")
    most = len(index.centers)
    exact = written(search(index, asked, k, most), "exact")
    probes = max(1, most // 16)
    while probes < most:
        row = recall(search(index, asked, k, probes), exact).first()
        if row.hit >= least * row.wanted:
            break
        probes = min(most, 2 * probes)
    return probes
