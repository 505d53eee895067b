"""Clusters: centroids, tiers, representatives, geometry, hierarchy and density clustering.

Centroids, sizes and tiers are aggregates. Hierarchies work on centroids, of which there are a few hundred, on the
driver. HDBSCAN compares every pair of the points it is given, so it takes a bounded sample; others are assigned to the
nearest centroid by `assign`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.vectors import cosine_distance, l2_distance, min_max, normalised
from millrace.operators.series import STOPWORDS

NOISE = -1


def tiered(labels: DataFrame, tiers: list[str]) -> DataFrame:
    """One row a member and tier: (…, tier, label)."""
    others = [c for c in labels.columns if c not in tiers]
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("tier"), F.col(t).alias("label")) for i, t in enumerate(tiers))))
    return labels.select(*others, pairs.alias("t")).select(*others, "t.tier", "t.label")


def tier_links(labels: DataFrame, child: str, parent: str) -> DataFrame:
    """Parent of each cluster of the tier below; noise has none."""
    return labels.where((F.col(child) != NOISE) & (F.col(parent) != NOISE)).select(child, parent).distinct()


def size_histogram(labels: DataFrame, label: str = "label") -> DataFrame:
    """Members of each cluster, noise too."""
    return labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def centroids(members: DataFrame, label: str = "label", embedding: str = "embedding", unit: bool = False) -> DataFrame:
    """Mean vector and size of each cluster in double precision, summed a dimension at a time; noise has none."""
    rows = members.where((F.col(label) != NOISE) & F.col(embedding).isNotNull()).select(label, F.posexplode(embedding).alias("i", "v"))
    mean = rows.groupBy(label, "i").agg(F.avg(F.col("v").cast("double")).alias("v"), F.count(F.lit(1)).alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"])  # one entry a dimension
    out = mean.groupBy(label).agg(ordered.alias("centroid"), F.max("n").alias("size"))
    return out.withColumn("centroid", normalised(F.col("centroid"))) if unit else out


def extent(members: DataFrame, label: str = "label", day: str = "day", default: str = "1845-06-01") -> DataFrame:
    """Size and first and last date of each cluster; the default where it has no date."""
    return members.where(F.col(label) != NOISE).groupBy(label).agg(
        F.count(F.lit(1)).alias("size"), F.coalesce(F.min(day), F.lit(default).cast("date")).alias("first_day"), F.coalesce(F.max(day), F.lit(default).cast("date")).alias("last_day")
    )


def rolled_up(leaves: DataFrame, parent: str, weight: str = "size", centroid: str = "centroid") -> DataFrame:
    """Centroid of each parent: the mean of its leaves' by size; sizes add up."""
    rows = leaves.select(parent, weight, F.posexplode(centroid).alias("i", "v"))
    mean = rows.groupBy(parent, "i").agg((F.sum(F.col("v") * F.col(weight)) / F.sum(weight)).alias("v"), F.sum(weight).alias("size"))
    return mean.groupBy(parent).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("centroid"), F.max("size").alias("size"))


def representatives(members: DataFrame, centers: DataFrame, most: int, label: str = "label", id_col: str = "id", embedding: str = "embedding", metric: str = "l2") -> DataFrame:
    """Members closest to their cluster's centroid."""
    distance = (l2_distance if metric == "l2" else cosine_distance)(F.col(embedding).cast("array<double>"), F.col("centroid"))
    near = members.join(F.broadcast(centers.select(label, "centroid")), label).withColumn("distance", F.round(distance, 9)).drop("centroid", embedding)
    w = Window.partitionBy(label).orderBy("distance", id_col)
    return near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def proportional_shares(leaves: DataFrame, parent: str, total: int, least_size: int = 20, label: str = "label", size: str = "size") -> DataFrame:
    """How many representatives each leaf gives to its parent: by size, one at least for the three largest, `total` in all.

    A running sum over a parent's few leaves stands for handing them out one after another."""
    w = Window.partitionBy(parent)
    ordered = w.orderBy(F.desc(size), label)
    df = leaves.withColumn("__all", F.sum(size).over(w)).where(F.col("__all") >= least_size)
    wanted = F.greatest(F.when(F.row_number().over(ordered) <= 3, 1).otherwise(0), F.bround(total * F.col(size) / F.col("__all")).cast("int"))
    df = df.withColumn("wanted", F.least(wanted, F.col(size).cast("int")))
    before = F.coalesce(F.sum("wanted").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("share", F.greatest(F.lit(0), F.least(F.col("wanted"), total - before)).cast("int")).where("share > 0").drop("__all", "wanted")


def active_geometry(members: DataFrame, tiers: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Place and number of the active content members of every cluster of every tier."""
    rows = tiered(members.where("status = 'active' and content_type = 0"), tiers).where(F.col("label") != NOISE)
    return rows.groupBy("tier", "label").agg(F.count(F.lit(1)).alias("n_active"), F.avg(x).alias("x"), F.avg(y).alias("y"))


def with_geometry(clusters: DataFrame, geometry: DataFrame) -> DataFrame:
    """clusters with their new geometry; zero where nothing active is left."""
    kept = clusters.drop("n_active", "x", "y").join(geometry, ["tier", "label"], "left")
    return kept.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_active", "x", "y")})


def sweep_metrics(runs: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Number of clusters, share of noise and median size of each run."""
    sizes = runs.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    real = F.col(label) != NOISE
    return sizes.groupBy(*keys).agg(
        F.count(F.when(real, 1)).alias("n_clusters"), (F.sum(F.when(~real, F.col("n")).otherwise(0)) / F.sum("n")).alias("noise"), F.percentile(F.when(real, F.col("n")), F.lit(0.5)).alias("median_size")
    )


def assign(points: DataFrame, centers: DataFrame, limit: float, label: str = "label", id_col: str = "id", embedding: str = "embedding") -> DataFrame:
    """Nearest frozen centroid of each point; emerging if it is farther than the limit from all. centers: a few hundred rows, one array literal a task."""
    table = centers.agg(F.array_sort(F.collect_list(F.struct(label, "centroid"))).alias("c"))
    df = points.withColumn("__c", table.scalar())
    near = F.array_min(F.transform("__c", lambda c: F.struct(F.round(cosine_distance(F.col(embedding).cast("array<double>"), c["centroid"]), 9).alias("distance"), c[label].alias(label))))
    return df.withColumn("__n", near).select(id_col, F.col(f"__n.{label}").alias(label), F.col("__n.distance").alias("distance"), (F.col("__n.distance") > limit).alias("emerging"))


def term_labels(members: DataFrame, cluster: str = "cluster", text: str = "text", terms: int = 3, least_members: int = 2, most: int = 120) -> DataFrame:
    """A label of each cluster from its most distinctive words: count * ln(all words / count over all), joined by commas. Offline, in place of a model that names topics.

    Counts come before anything is gathered, and only the first few words of a cluster are."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0)), lambda t: ~t.isin(STOPWORDS))
    counts = members.select(cluster, F.explode(words).alias("term")).groupBy(cluster, "term").agg(F.count(F.lit(1)).alias("n"))
    overall = counts.groupBy("term").agg(F.sum("n").alias("f"))
    total = counts.agg(F.sum("n").alias("t"))
    scored = counts.where(F.col("n") >= least_members).join(overall, "term").withColumn("__all", total.scalar())
    scored = scored.withColumn("score", F.round(F.col("n") * F.log(F.col("__all") / F.col("f")), 6))
    first = scored.withColumn("place", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("score"), "term"))).where(F.col("place") <= terms)
    named = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]), ", ")
    return first.groupBy(cluster).agg(F.substring(named, 1, most).alias("label"))


def map_export(points: DataFrame, order: str = "id", size: int = 1000) -> DataFrame:
    """Parallel arrays in id order, a row for each block of `size` ids, so that no row grows with the map."""
    fields = [c for c in points.columns if c != order]
    rows = points.groupBy(F.floor(F.col(order) / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("r"))
    return rows.select("block", *(F.col(f"r.{c}").alias(c) for c in [order, *fields]))


def scaled_layout(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """x and y on [0, 1]; 0.5 where all are equal."""
    bounds = points.agg(*(f(c).alias(f"{n}_{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))))
    df = points.withColumn("__b", bounds.select(F.struct("*").alias("b")).scalar())
    return df.withColumns({c: min_max(F.col(c), F.col(f"__b.lo_{c}"), F.col(f"__b.hi_{c}")) for c in (x, y)}).drop("__b")


def drill_down(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Child topics under the parent whose leaves hold their first leaf, largest first. Both: name, leaves, size."""
    a, b = parents.select(F.col("name").alias("parent"), F.explode("leaves").alias("leaf")), children.withColumn("leaf", F.get("leaves", F.lit(0)))
    w = Window.partitionBy("parent").orderBy(F.desc("size"), "name")
    return b.join(a, "leaf").withColumn("place", F.row_number().over(w)).select("parent", "name", "size", "place")


def focus(isolated: Column, searched: Column) -> Column:
    """Leaves in focus: what both sets hold, else the one that is set, else null for all."""
    return F.when(isolated.isNotNull() & searched.isNotNull(), F.array_intersect(isolated, searched)).otherwise(F.coalesce(isolated, searched))


def topic_search(topics: DataFrame, text: str) -> DataFrame:
    """Topics whose label holds the text, and how many passages they have."""
    return topics.where(F.contains(F.lower("label"), F.lit(text.lower())))


def nearest_point(points: DataFrame, px: float, py: float, radius: float = 14.0, id_col: str = "id") -> DataFrame:
    """The point nearest to a place, within a radius."""
    d2 = (F.col("x") - px) * (F.col("x") - px) + (F.col("y") - py) * (F.col("y") - py)
    return points.withColumn("d2", d2).where(F.col("d2") <= radius * radius).orderBy("d2", id_col).limit(1)


def bounding_box(points: DataFrame) -> DataFrame:
    return points.agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.count(F.lit(1)).alias("n"))


def principal_layout(df: DataFrame, embedding: str = "embedding", id_col: str = "id", k: int = 2) -> DataFrame:
    """A linear layout by principal components: the declared substitute for a manifold projection."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.where(F.col(embedding).isNotNull()).select(id_col, array_to_vector(F.col(embedding).cast("array<double>")).alias("__v"))
    model = PCA(k=k, inputCol="__v", outputCol="__p").fit(rows)
    return model.transform(rows).select(id_col, *(F.get(vector_to_array("__p"), F.lit(i)).alias(f"p{i}") for i in range(k)))


def linkage(vectors: np.ndarray, method: str) -> np.ndarray:
    """Agglomerative merges (a, b, height, size): "ward" on Euclidean, "average" on cosine distances. For a few hundred rows."""
    n = len(vectors)
    if method == "ward":
        d = ((vectors[:, None, :] - vectors[None, :, :]) ** 2).sum(-1)
    else:
        length = np.linalg.norm(vectors, axis=1)
        unit = vectors / np.where(length > 0, length, 1)[:, None]
        d = np.where((length[:, None] > 0) & (length[None, :] > 0), 1 - unit @ unit.T, 1.0)
    d = d.astype(float)
    np.fill_diagonal(d, np.inf)
    size, name, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    merges = []
    for step in range(n - 1):
        i, j = np.unravel_index(np.argmin(d), d.shape)
        i, j = min(i, j), max(i, j)
        height, ni, nj = d[i, j], size[i], size[j]
        merges.append((name[i], name[j], float(np.sqrt(height)) if method == "ward" else float(height), ni + nj))
        if method == "ward":
            row = ((ni + size) * d[i] + (nj + size) * d[j] - size * height) / (ni + nj + size)
        else:
            row = (ni * d[i] + nj * d[j]) / (ni + nj)
        row[~alive] = np.inf
        row[[i, j]] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        size[i], name[i], alive[j] = ni + nj, n + step, False
    return np.array(merges).reshape(-1, 4)


def cut(merges: np.ndarray, n: int, k: int) -> list[int]:
    """Labels from 0 of at most k clusters; numbered by their first member."""
    parent = list(range(2 * n))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for step in range(max(0, n - max(1, k))):
        a, b = int(merges[step, 0]), int(merges[step, 1])
        parent[root(a)] = parent[root(b)] = n + step
    seen: dict[int, int] = {}
    return [seen.setdefault(root(i), len(seen)) for i in range(n)]


def hierarchy(centers: DataFrame, targets: list[int], method: str, label: str = "label", least: int = 3) -> DataFrame:
    """Each leaf's cluster at each cut: one linkage, many cuts, so the tiers nest. Ward takes unit centroids and skips cuts outside [2, n)."""
    pdf: pd.DataFrame = centers.select(label, "centroid").orderBy(label).toPandas()  # a few hundred centroids
    n = len(pdf)
    if method == "ward":
        targets = [k for k in targets if 2 <= k < n] if n >= least else []
    vectors = np.array(pdf["centroid"].tolist(), float).reshape(n, -1)
    if method == "ward" and n:
        length = np.linalg.norm(vectors, axis=1, keepdims=True)
        vectors = vectors / np.where(length > 0, length, 1)
    merges = linkage(vectors, method) if n > 1 else np.empty((0, 4))
    out = {label: pdf[label].tolist()} | {f"k{k}": cut(merges, n, min(k, n)) for k in targets}
    schema = ", ".join([f"{label} int", *(f"k{k} int" for k in targets)])
    return centers.sparkSession.createDataFrame(pd.DataFrame(out), schema)


def hdbscan(points: np.ndarray, min_cluster_size: int = 15, min_samples: int = 5) -> np.ndarray:
    """Leaf clusters of HDBSCAN (Campello, Moulavi and Sander 2013) on Euclidean distances; -1 is noise."""
    n = len(points)
    if n < min_cluster_size:
        return np.full(n, NOISE)
    core = np.empty(n)
    for lo in range(0, n, 512):  # blocks bound the memory
        d = np.sqrt(np.maximum(((points[lo : lo + 512, None, :] - points[None, :, :]) ** 2).sum(-1), 0))
        core[lo : lo + 512] = np.partition(d, min(min_samples, n - 1), axis=1)[:, min(min_samples, n - 1)]
    # Minimum spanning tree of the mutual reachability graph (Prim)
    near, link, done, at = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool), 0
    edges = []
    for _ in range(n - 1):
        done[at] = True
        d = np.maximum(np.maximum(np.sqrt(((points - points[at]) ** 2).sum(-1)), core), core[at])
        closer = ~done & (d < near)
        near[closer], link[closer] = d[closer], at
        nxt = int(np.argmin(np.where(done, np.inf, near)))
        edges.append((near[nxt], link[nxt], nxt))
        at = nxt
    edges.sort()
    # Single linkage tree
    top, members, children = list(range(n)), {i: 1 for i in range(n)}, {}

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for step, (height, a, b) in enumerate(edges):
        a, b, new = root(a), root(b), n + step
        top += [new]
        top[a] = top[b] = new
        members[new], children[new] = members[a] + members[b], (a, b, height)
    # Condensed: a split counts where both sides have enough members; leaves are the clusters that never split again
    labels, found = np.full(n, NOISE), 0

    def points_of(node: int) -> list[int]:
        todo, out = [node], []
        while todo:
            x = todo.pop()
            if x < n:
                out.append(x)
            else:
                todo += children[x][:2]
        return out

    todo, leaves = [(n + len(edges) - 1, False)], []
    while todo:
        born, split = todo.pop()
        node = born
        while node >= n:
            a, b, _ = children[node]
            big = [c for c in (a, b) if members[c] >= min_cluster_size]
            if len(big) == 2:
                todo += [(a, True), (b, True)]
                break
            if not big:
                leaves.append((born, split))
                break
            node = big[0]
        else:
            leaves.append((born, split))
    for born, split in sorted(leaves):
        if split:  # the root alone is no cluster
            labels[points_of(born)] = found
            found += 1
    return labels
