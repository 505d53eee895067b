"""Density clusters of all rows: HDBSCAN's mutual reachability tree in Spark rounds.

1. Every row's nearest rows (an inverted-file index) give its core distance and the edges of a neighbour graph, weighted by
   the largest of both core distances and the distance.
2. Boruvka rounds: every component takes its lightest edge to another one; components that meet become one. When the graph
   has no edge left between components, all but the largest look for their nearest row outside, with more and more probes.
3. The tree's edges in order of weight are merged batch by batch. A component of `min_cluster_size` rows is a seed; an edge
   below which two seeds lie is cut. What stays together, and holds a seed, is a leaf cluster; the rest is noise.

With as many neighbours as rows, or all cells probed and lists that reach far enough, the tree is exact; else it is the
tree of the neighbour graph. Edges of equal weight go by their ids. Equal vectors are rows like any other. Rows without a
vector are noise. A component's size, not its rows, is what a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import nearest
from millrace.operators.rounds import written

NOISE = -1
BATCH = 1 << 20  # edges that one task merges, in order of weight


@dataclass
class Tree:
    """edges: (a, b, weight), a spanning tree of all rows with a vector; n: their number."""

    edges: DataFrame
    n: int


def spanning_tree(points: DataFrame, min_samples: int = 5, neighbours: int = 15, probes: int = 16, id_col: str = "id", embedding: str = "embedding", cells: int | None = None) -> Tree | None:
    """The mutual reachability tree. probes: cells that a row visits for its neighbours; `nearest.tuned` tells how many a recall takes."""
    index = nearest.build(points, id_col, embedding, cells)
    if index is None:
        return None
    k = max(min_samples, neighbours)
    lists = written(nearest.search(index, index.rows.select("id", "v"), k, probes, others_only=True), "neighbours")
    # The last known neighbour stands in where a row found fewer.
    core = written(lists.where(F.col("rank") <= min_samples).groupBy("query").agg(F.max("distance").alias("core")).withColumnRenamed("query", "id"), "core")
    a, b = core.select(F.col("id").alias("query"), F.col("core").alias("ca")), core.select("id", F.col("core").alias("cb"))
    pairs = lists.join(a, "query").join(b, "id").select(F.least("query", "id").alias("a"), F.greatest("query", "id").alias("b"), F.greatest("distance", "ca", "cb").alias("weight"))
    graph = written(pairs.groupBy("a", "b").agg(F.min("weight").alias("weight")), "graph")
    return Tree(_forest(index, core, graph), index.n)


def _forest(index: nearest.Index, core: DataFrame, graph: DataFrame) -> DataFrame:
    """Boruvka's rounds until one component is left."""
    labels = written(index.rows.select("id", F.col("id").alias("c")), "labels")
    edges = written(graph.withColumns({"ca": F.col("a"), "cb": F.col("b")}), "edges")
    chosen, probes, left = [], 1, index.n
    while left > 1:
        best = _lightest(edges)
        if best.isEmpty():
            best, probes = _outside(index, core, labels, probes)
        best = written(best, "lightest")
        chosen.append(best.select("a", "b", "weight"))
        roots = _roots(best.select(F.col("c"), F.col("to").alias("parent")))
        labels = written(_relabelled(labels, "c", roots), "labels")
        edges = written(_relabelled(_relabelled(edges, "ca", roots), "cb", roots).where("ca <> cb"), "edges")
        left = labels.select("c").distinct().count()
    out = chosen[0] if chosen else graph.limit(0)
    for more in chosen[1:]:
        out = out.unionByName(more)
    return written(out.distinct(), "tree")


def _lightest(edges: DataFrame) -> DataFrame:
    """(c, to, a, b, weight): each component's lightest edge to another one, ties by ids."""
    both = edges.select(F.col("ca").alias("c"), F.col("cb").alias("to"), "a", "b", "weight").unionByName(edges.select(F.col("cb").alias("c"), F.col("ca").alias("to"), "a", "b", "weight"))
    return both.groupBy("c").agg(F.min(F.struct("weight", "a", "b", "to")).alias("e")).select("c", "e.to", "e.a", "e.b", "e.weight")


def _roots(parents: DataFrame) -> DataFrame:
    """(c, root) of pointers (c, parent) whose only cycles are pairs: the smaller of a pair is the root. Pointers double their reach each round."""
    other = parents.select(F.col("c").alias("parent"), F.col("parent").alias("back"))
    up = parents.join(other, "parent", "left").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("parent")), F.col("c")).otherwise(F.col("parent")).alias("root"))
    up = written(up, "roots")
    while True:
        over = up.select(F.col("c").alias("root"), F.col("root").alias("above"))
        after = written(up.join(over, "root", "left").select("c", F.coalesce("above", "root").alias("root"), (F.coalesce("above", "root") != F.col("root")).alias("moved")), "roots")
        up = after.select("c", "root")
        if after.where("moved").isEmpty():
            return up


def _relabelled(rows: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    kept = [c for c in rows.columns if c != column]
    return rows.join(roots.select(F.col("c").alias(column), "root"), column, "left").select(*kept, F.coalesce("root", column).alias(column))


def _outside(index: nearest.Index, core: DataFrame, labels: DataFrame, probes: int) -> tuple[DataFrame, int]:
    """The lightest edge of every component but the largest to a row of another one, and how many probes it took."""
    sizes = labels.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.orderBy(F.desc("n"), "c").first()["c"]
    known = index.rows.join(core, "id", "left").join(labels, "id").withColumn("core", F.coalesce("core", F.lit(0.0)))
    known = nearest.Index(written(known, "known"), index.cells, index.centers, index.n)
    asked = known.rows.where(F.col("c") != largest).select("id", "v", "core", "c")

    def run(q: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(q) or not len(rows):
            return pa.table({k: pa.array([], t) for k, t in (("c", pa.int64()), ("to", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("weight", pa.float64()))})
        weight = np.sqrt(nearest.squared(nearest.matrix(q["v"]), nearest.matrix(rows["v"])))
        weight = np.maximum(np.maximum(weight, q["core"].to_numpy()[:, None]), rows["core"].to_numpy()[None, :])
        ours, theirs = q["c"].to_numpy(), rows["c"].to_numpy()
        weight[ours[:, None] == theirs[None, :]] = np.inf
        at = weight.argmin(1)
        real = np.isfinite(weight[np.arange(len(at)), at])
        x, y = q["id"].to_numpy()[real], rows["id"].to_numpy()[at[real]]
        return pa.table({"c": ours[real], "to": theirs[at[real]], "a": np.minimum(x, y), "b": np.maximum(x, y), "weight": weight[real, at[real]]})

    most = len(index.centers)
    while True:
        found = nearest.meet(known, asked, probes, run, "c long, to long, a long, b long, weight double")
        best = written(found.groupBy("c").agg(F.min(F.struct("weight", "a", "b", "to")).alias("e")).select("c", "e.to", "e.a", "e.b", "e.weight"), "outside")
        if probes >= most or not best.isEmpty():
            return best, probes
        probes = min(most, 4 * probes)


def _merge(min_size: int):
    """Merges edges in order of weight; gives each edge's `cut` and each component's new state."""

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["b"].to_numpy(), table["a"].to_numpy(), table["weight"].to_numpy()))
        columns = [table[c].to_numpy()[order].tolist() for c in ("ca", "cb", "na", "nb", "sa", "sb", "a", "b")]
        top: dict[int, int] = {}
        size: dict[int, int] = {}
        seeds: dict[int, int] = {}

        def root(x: int) -> int:
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        cuts = []
        for ca, cb, na, nb, sa, sb, _, _ in zip(*columns, strict=True):
            for c, n, s in ((ca, na, sa), (cb, nb, sb)):
                if c not in top:
                    top[c], size[c], seeds[c] = c, n, s
            x, y = root(ca), root(cb)
            x, y = min(x, y), max(x, y)
            top[y] = x
            size[x] += size[y]
            seeds[x] = seeds[x] + seeds[y] or int(size[x] >= min_size)
            cuts.append(int(seeds[x] >= 2))
        edge = pa.table({"kind": ["edge"] * len(cuts), "x": columns[6], "y": columns[7], "n": pa.array(cuts, pa.int64()), "s": pa.array([0] * len(cuts), pa.int64())})
        state = [(c, root(c)) for c in top]
        moved = pa.table({"kind": ["component"] * len(state), "x": [c for c, _ in state], "y": [r for _, r in state], "n": pa.array([size[r] for _, r in state], pa.int64()), "s": pa.array([seeds[r] for _, r in state], pa.int64())})
        return pa.concat_tables([edge, moved])

    return run


def clusters(tree: Tree, min_cluster_size: int = 15) -> DataFrame:
    """(id, label) of the rows in leaf clusters, labelled from 0 in order of their first id. A tree that never splits has none."""
    spark = tree.edges.sparkSession
    none = spark.createDataFrame([], "id long, label int")
    if tree.n < max(2, min_cluster_size):
        return none
    ends = tree.edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    state = written(ends.select("id", F.col("id").alias("c"), F.lit(1).cast("long").alias("n"), F.lit(int(min_cluster_size <= 1)).cast("long").alias("s")), "state")
    batches = max(1, -(-tree.n // BATCH))
    bounds = tree.edges.approxQuantile("weight", [i / batches for i in range(1, batches)], 0.1 / batches) if batches > 1 else []
    limits = [float("-inf"), *sorted(set(bounds)), float("inf")]
    kept = []
    for low, high in zip(limits, limits[1:], strict=False):
        batch = tree.edges.where((F.col("weight") > low) & (F.col("weight") <= high))
        for end, c in (("a", "ca"), ("b", "cb")):
            batch = batch.join(state.select(F.col("id").alias(end), F.col("c").alias(c), F.col("n").alias(f"n{end}"), F.col("s").alias(f"s{end}")), end)
        out = written(batch.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(lambda t: _merge(min_cluster_size)(t), "kind string, x long, y long, n long, s long"), "merged")
        kept.append(out.where("kind = 'edge' and n = 0").select(F.col("x").alias("a"), F.col("y").alias("b")))
        if high != float("inf"):
            moved = out.where("kind = 'component'").select(F.col("x").alias("c"), F.col("y").alias("to"), F.col("n").alias("more"), F.col("s").alias("seeds"))
            state = written(state.join(moved, "c", "left").select("id", F.coalesce("to", "c").alias("c"), F.coalesce("more", "n").alias("n"), F.coalesce("seeds", "s").alias("s")), "state")
    whole = kept[0]
    for more in kept[1:]:
        whole = whole.unionByName(more)
    whole = written(whole, "kept")
    if whole.count() == tree.n - 1:
        return none
    found = connected(ends, whole)
    sizes = found.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_cluster_size)
    named = sizes.select("c", (F.row_number().over(Window.orderBy("c")) - 1).cast("int").alias("label"))  # a row a cluster
    return found.join(named, "c").select("id", "label")


def connected(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, c): the smallest id that edges (a, b) connect with each id. Components take their smallest neighbour as parent, so pointers run downwards, until none has a smaller one."""
    labels = written(ids.select("id", F.col("id").alias("c")), "labels")
    rest = written(edges.select("a", "b").where("a <> b"), "rest")
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least"))
        # A component points down if it can, else it stays; a local minimum gathers its neighbours.
        parents = written(least.select(F.col("a").alias("c"), F.least("a", "least").alias("parent")), "parents")
        roots = _roots(parents)
        labels = written(_relabelled(labels, "c", roots), "labels")
        rest = written(_relabelled(_relabelled(rest, "a", roots), "b", roots).where("a <> b").distinct(), "rest")
    return labels


def labelled(points: DataFrame, found: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, label) of every point, noise included."""
    return points.select(F.col(id_col).alias("id")).join(found, "id", "left").select("id", F.coalesce("label", F.lit(NOISE)).alias("label"))


def validity(tree: Tree, found: DataFrame) -> DataFrame:
    """One row (dbcv): relative density validity of labels (id, label) from the tree (Moulavi et al. 2014, on the tree's edges): separation against sparseness of each cluster, weighted by its share of all rows. NaN without clusters.

    Sparseness is the heaviest edge inside; separation the lightest to another cluster, or twice the tree's heaviest edge, or with a single cluster twice the lightest edge to noise."""
    ends = tree.edges
    for end in ("a", "b"):
        ends = ends.join(found.select(F.col("id").alias(end), F.col("label").alias(f"l{end}")), end, "left")
    ends = written(ends.select("weight", "la", "lb"), "ends")
    totals = ends.agg(F.max("weight").alias("heaviest"), F.min(F.when(F.col("la").isNull() != F.col("lb").isNull(), F.col("weight"))).alias("to_noise"))
    inside = ends.where("la = lb").groupBy(F.col("la").alias("label")).agg(F.max("weight").alias("sparse"))
    between = ends.where("la <> lb").select(F.explode(F.array("la", "lb")).alias("label"), "weight").groupBy("label").agg(F.min("weight").alias("apart"))
    each = found.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(inside, "label", "left").join(between, "label", "left")
    each = each.crossJoin(F.broadcast(totals))  # one row
    several = F.count(F.lit(1)).over(Window.partitionBy()) > 1
    each = each.withColumn("limit", 2 * F.when(several, F.col("heaviest")).otherwise(F.coalesce("to_noise", "heaviest")))
    apart, sparse = F.coalesce("apart", "limit"), F.coalesce("sparse", F.lit(0.0))
    score = F.when(F.greatest(apart, sparse) > 0, (apart - sparse) / F.greatest(apart, sparse)).otherwise(0.0)
    return each.agg(F.coalesce(F.sum(F.col("n") * score) / tree.n, F.lit(float("nan"))).alias("dbcv"))


def sweep(spark: SparkSession, points: DataFrame, sizes: list[int], tree: Tree | None) -> Iterator[dict]:
    """Number of clusters, share of noise, median size and validity for each least size, all from one tree."""
    n = points.count()
    for size in sizes:
        found = written(clusters(tree, size), "clusters") if tree else spark.createDataFrame([], "id long, label int")
        counts = found.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("inside"), F.percentile("n", F.lit(0.5)).alias("median")).first()
        dbcv = validity(tree, found).first()["dbcv"] if tree else float("nan")
        yield {"min_cluster_size": size, "n_clusters": counts["k"], "noise": 1 - (counts["inside"] or 0) / n if n else 0.0, "median_size": counts["median"] or 0.0, "dbcv": dbcv}
