from __future__ import annotations

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import analytics, clusters, density, incremental, layout, nearest, retrieval, series
from millrace.plans import cluster_queries
from millrace.sources import manifests


def schedule(spark, rows):
    return spark.createDataFrame(rows, "grp string, unit string, school_year string, lane string, step int, salary double, source long")


def test_step_slope_and_absence(spark):
    rows = [("a", "teacher", "2023-24", "MA", 1, 92410.0, 1), ("a", "teacher", "2023-24", "MA", 10, 118750.0, 2), ("a", "teacher", "2024-25", "MA", 1, 93000.0, 3), ("b", "teacher", "2023-24", "MA", 1, 90000.0, 4), ("c", "aide", "2023-24", "MA", 1, 1.0, 5), ("c", "aide", "2023-24", "MA", 10, 2.0, 6)]
    df = schedule(spark, rows)
    out = analytics.step_slope(df, "MA", 1, 10)
    assert [(r.grp, r.school_year, r.delta, r.source) for r in out.collect()] == [("a", "2023-24", 26340.0, 2)]
    assert [r.grp for r in analytics.not_available(df, out).collect()] == ["b", "c"]


def test_value_and_source_come_from_one_row(spark):
    df = schedule(spark, [("a", "teacher", "2023-24", "MA", 1, 5.0, 9), ("a", "teacher", "2023-24", "MA", 1, 7.0, 4), ("a", "teacher", "2023-24", "MA", 1, 7.0, 3)])
    assert tuple(analytics.max_at_step(df, "MA", 1).first()) == ("a", "2023-24", 7.0, 3)


def test_router_is_closed():
    assert analytics.Decision("analytical", "drop_tables").checked().kind == "semantic"
    for d in (analytics.Decision("semantic"), analytics.Decision("analytical", "max_at_step", {}), analytics.Decision("analytical", "step_slope", {"step_from": 1, "step_to": 1})):
        with pytest.raises(analytics.UnsupportedQuery):
            analytics.run(d, None)


def test_audit(spark):
    rows = [("a", "teacher", "2023-24", "MA", 1, 50000.0, 1), ("a", "teacher", "2023-24", "MA", 2, 49000.0, 2), ("a", "teacher", "2023-24", "MA+30", 1, 48000.0, 3), ("a", "teacher", "2024-25", "MA", 1, 45000.0, 4), ("a", "aide", "2023-24", "Helper", 1, 20000.0, 5)]
    got = {(r.kind, r.cell) for r in analytics.audit(schedule(spark, rows)).collect()}
    assert got == {("salary_non_monotonic", "2023-24/MA/2"), ("lane_out_of_order", "2023-24/MA+30/1"), ("year_over_year_drop", "2024-25/MA/1"), ("salary_out_of_bounds", "2023-24/Helper/1")}


def test_fusion_and_cap(spark):
    legs = [spark.createDataFrame([("x", 1), ("y", 2)], "chunk_id string, rank int"), spark.createDataFrame([("y", 1), ("z", 2)], "chunk_id string, rank int")]
    assert [r.chunk_id for r in retrieval.fuse(legs).orderBy("fused_rank").collect()] == ["y", "x", "z"]
    rows = spark.createDataFrame([("d", i, doc) for i, doc in enumerate(["p", "p", "p", "q", "p"], 1)], "district string, rank int, doc string")
    kept = retrieval.capped(rows, "doc", "rank", 4, 2).orderBy("place").collect()
    assert [(r.rank, r.overflow) for r in kept] == [(1, False), (2, False), (4, False), (3, True)]


def test_mmr_prefers_what_is_new():
    assert retrieval.mmr([("a", 1.0, [1, 0]), ("b", 0.99, [1, 0]), ("c", 0.5, [0, 1])], 2) == ["a", "c"]


def test_absent_embeddings_take_no_part(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", None), (3, "a", [0.0, 0.0])], "chunk_id int, district string, embedding array<float>")
    assert [(r.chunk_id, r.distance) for r in retrieval.semantic_leg(df, [1.0, 0.0], 5, "district").orderBy("rank").collect()] == [(1, 0.0), (3, 1.0)]


def test_drift_of_a_turning_cluster(spark):
    day = lambda w: datetime.date(2024, 1, 1) + datetime.timedelta(weeks=w)
    df = spark.createDataFrame([(1, day(0), [1.0, 0.0], 5), (1, day(1), [0.0, 1.0], 5), (1, day(2), [1.0, 0.0], 5), (2, day(0), [1.0, 0.0], 5)], "cluster int, week_start date, centroid array<double>, n int")
    got = {r.cluster: (r.path, r.net, r.ratio) for r in series.drift(df).collect()}
    assert got == {1: (2.0, 0.0, 0.0), 2: (0.0, 0.0, None)}


def test_rate_limiter_replays(spark):
    rng = random.Random(5)
    calls = sorted((f"k{rng.randrange(3)}", round(rng.uniform(0, 100), 3)) for _ in range(300))
    df = spark.createDataFrame(calls, "key string, at double").repartition(7)
    got = sorted(((r.key, r.at), r.allowed) for r in incremental.rate_limited(df, 10.0, 4).collect())
    logs, want = {}, []
    for k, t in calls:
        log = [s for s in logs.get(k, []) if t - s < 10]
        ok = len(log) < 4
        logs[k] = [*log, t] if ok else log
        want.append(((k, t), ok))
    assert got == sorted(want)


def test_packed_requests(spark):
    df = spark.createDataFrame([(1, "x" * 30000), (2, "x" * 30000), (3, "  "), (4, "x" * 30000), (5, None)], "id int, text string").coalesce(1)
    rows = incremental.packed(df, "id", most_tokens=50_000).orderBy("id").collect()
    assert [r.batch for r in rows] == [0, 0, None, 1, None]
    many = spark.range(300).withColumn("text", F.lit("a")).coalesce(1)
    assert [r["count"] for r in incremental.packed(many, "id").groupBy("batch").count().orderBy("batch").collect()] == [128, 128, 44]


def test_hdbscan_finds_the_groups():
    rng = np.random.default_rng(7)
    points = np.concatenate([rng.normal(c, 0.02, (30, 8)) for c in (np.zeros(8), np.ones(8))] + [rng.uniform(-5, 5, (10, 8))])
    labels = clusters.hdbscan(points)
    assert set(labels[:30]) == {0} or set(labels[:30]) == {1}
    assert len(set(labels[:60])) == 2 and labels[0] != labels[59]
    assert set(clusters.hdbscan(points[:5])) == {clusters.NOISE}


def test_hierarchies_nest(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 4)]) for i in range(12)]
    df = spark.createDataFrame(rows, "label int, centroid array<double>")
    for method in ("ward", "average"):
        out = clusters.hierarchy(df, [6, 3], method).toPandas()
        assert out["k6"].nunique() == 6 and out["k3"].nunique() == 3
        assert (out.groupby("k6")["k3"].nunique() == 1).all()
    assert clusters.hierarchy(df.limit(2), [2], "ward").columns == ["label"]


def test_linkage_joins_the_nearest():
    merges = clusters.linkage(np.array([[0.0], [1.0], [10.0]]), "ward")
    assert merges[0][:2].tolist() == [0, 1] and merges[0][2] == 1.0


def test_changes_and_merges(spark):
    old = spark.createDataFrame([(1, "A  b"), (2, "x"), (3, "y")], "id int, text string")
    new = spark.createDataFrame([(1, "a B"), (2, "z"), (4, None)], "id int, text string")
    assert {r.id: r.change for r in incremental.changes(old, new, "id", "text").collect()} == {1: "UNCHANGED", 2: "UPDATED", 3: "GONE", 4: "NEW"}
    assert sorted(map(tuple, incremental.upsert(old, new, ["id"]).collect())) == [(1, "a B"), (2, "z"), (3, "y"), (4, None)]
    assert sorted(map(tuple, incremental.replaced(old, new, ["id"]).collect())) == [(1, "a B"), (2, "z"), (3, "y")]


def test_density_labels_cover_every_row(spark, tmp_path):
    blobs = cluster_queries._blobs()
    rows = [(int(i), [float(v) for v in e]) for i, e in zip(blobs["id"], blobs["embedding"], strict=True)]
    spark.createDataFrame([*rows, (1000, None)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    labels = {r.id: r.label for r in cluster_queries.hdbscan_labels(spark, str(tmp_path)).collect()}
    assert sorted(labels) == [*range(140), 1000] and labels[1000] == clusters.NOISE
    groups = [{labels[i] for i in range(lo, lo + 40)} for lo in (0, 40, 80)]
    assert all(len(g) == 1 for g in groups) and set.union(*groups) == {0, 1, 2}
    spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/few/embeddings.parquet")
    assert [r.label for r in cluster_queries.hdbscan_labels(spark, f"{tmp_path}/few").collect()] == [clusters.NOISE] * 5


def test_a_body_that_was_never_fetched_is_not_seen(spark):
    rows = [(1, "other", "u1", "h1"), (2, "other", "u1", "h2"), (3, "other", "u2", "h2"), (4, "other", "u3", "h2"), (5, "policy", "u4", "h2"), (6, "policy", "u4", "h2"), (7, "policy", "u4", "h3"), (8, "other", "u5", "h3")]
    df = spark.createDataFrame(rows, "id int, doc_type string, source_url string, sha256 string")
    got = {r.id: r.fate for r in incremental.manifest_status(df, ["id"]).collect()}
    assert got == {1: "stored", 2: "skipped", 3: "stored", 4: "recorded", 5: "stored", 6: "skipped", 7: "stored", 8: "recorded"}


def test_map_export_in_blocks(spark):
    df = spark.createDataFrame([(i, i % 3) for i in (5, 0, 12, 7, 11)], "id long, label int")
    assert [tuple(r) for r in clusters.map_export(df, size=10).orderBy("block").collect()] == [(0, [0, 5, 7], [0, 2, 1]), (1, [11, 12], [2, 0])]


def test_packed_requests_as_one_walk(spark):
    """Against a single pass, with texts larger than a request and partitions smaller than one."""
    rng = np.random.default_rng(5)
    for most_inputs, most_tokens, high in ((7, 60, 30), (200, 1000, 90), (3, 20, 40)):
        texts = [(i * 3, None if i % 17 == 0 else " " * (i % 3) if i % 11 == 0 else "x" * int(rng.integers(1, high))) for i in range(400)]
        want, batch, inputs, tokens = {}, 0, 0, 0
        for i, t in texts:
            if t is None or not t.strip():
                want[i] = None
                continue
            n = int(len(t) / 1.5) + 1
            if inputs and (inputs >= most_inputs or tokens + n > most_tokens):
                batch, inputs, tokens = batch + 1, 0, 0
            inputs, tokens, want[i] = inputs + 1, tokens + n, batch
        df = spark.createDataFrame(texts, "id long, text string").repartition(5)
        assert {r.id: r.batch for r in incremental.packed(df, "id", most_inputs=most_inputs, most_tokens=most_tokens).collect()} == want


def test_moving_centroid_by_fold(spark):
    rng = np.random.default_rng(6)
    rows = [(int(t), i, [float(x) for x in rng.normal(size=3)]) for i, t in enumerate([1] * 40 + [2] + [3] * 5)] + [(1, 100, None), (None, 101, [1.0, 2.0, 3.0])]
    want = {}
    for t, _, v in rows:
        if t and v:
            want[t] = np.array(v) if t not in want else 0.7 * want[t] + 0.3 * np.array(v)
    got = {r.thread: r for r in series.moving_centroid(spark.createDataFrame(rows, "thread long, at long, v array<double>"), "thread", "at", "v").collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[t].ema, want[t]) for t in want)
    assert abs(got[2].drift) < 1e-12


def test_crawl_stops_at_its_limit(spark):
    edges = spark.createDataFrame([(f"http://h/{i}", f"http://h/{2 * i + k}") for i in range(64) for k in (1, 2)] + [("http://h/0", "http://other/1")], "url string, target string")
    seeds = spark.createDataFrame([("http://h/0",), ("http://other/0",)], "url string")
    walk = lambda depth, most: [(r.url, r.depth) for r in manifests.crawl(edges, seeds, depth, most, "h").collect()]
    assert len(walk(3, 1000)) == 15 and max(d for _, d in walk(3, 1000)) == 3
    assert walk(9, 4) == [("http://h/0", 0), ("http://h/1", 1), ("http://h/2", 1), ("http://h/3", 2)]


def partition(labels):
    groups = {}
    for i, label in labels.items():
        groups.setdefault(label, set()).add(i)
    return sorted(sorted(g) for label, g in groups.items() if label != clusters.NOISE)


def scattered(seed):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(rng.normal(0, 3, 4), rng.uniform(0.1, 1), (rng.integers(20, 60), 4)) for _ in range(5)] + [rng.uniform(-6, 6, (40, 4))])


def test_density_clusters_equal_a_single_machine(spark, monkeypatch):
    """With lists of all rows the tree is exact: the same clusters as the plain algorithm, in one batch and in many, and the tree's own validity."""
    points = scattered(1)
    n = len(points)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(points)], "id long, embedding array<double>")
    tree = density.spanning_tree(df, 5, n, probes=n)
    assert tree.edges.count() == n - 1
    found = density.clusters(tree, 15)
    labels = {r.id: r.label for r in density.labelled(df, found).collect()}
    assert partition(labels) == partition(dict(enumerate(clusters.hdbscan(points, 15, 5).tolist())))
    monkeypatch.setattr(density, "BATCH", 60)
    assert partition({r.id: r.label for r in density.clusters(tree, 15).collect()}) == partition(labels)
    assert density.clusters(tree, 200).count() == 0
    # Relative validity by its definition
    edges = [tuple(r) for r in tree.edges.collect()]
    heaviest, score = max(w for *_, w in edges), 0.0
    for c in set(labels.values()) - {clusters.NOISE}:
        sparse = max([w for a, b, w in edges if labels[a] == labels[b] == c], default=0.0)
        apart = min([w for a, b, w in edges if (labels[a] == c) != (labels[b] == c) and clusters.NOISE not in (labels[a], labels[b])], default=2 * heaviest)
        score += sum(v == c for v in labels.values()) * (apart - sparse) / max(apart, sparse) / n
    assert abs(density.validity(tree, found).first().dbcv - score) < 1e-9
    assert np.isnan(density.validity(tree, density.clusters(tree, 200)).first().dbcv)


def test_density_clusters_join_what_the_lists_leave_apart(spark):
    """Short lists leave components; they find each other by more and more probes."""
    blobs = cluster_queries._blobs()
    df = spark.createDataFrame([(int(i), [float(v) for v in e]) for i, e in zip(blobs["id"], blobs["embedding"], strict=True)], "id long, embedding array<double>")
    tree = density.spanning_tree(df, 3, 3, probes=1, cells=6)
    assert tree.edges.count() == 139
    assert len(partition({r.id: r.label for r in density.clusters(tree, 15).collect()})) == 3


def test_inverted_file(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 40)
    points = scattered(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(points)] + [(900, None), (901, [1.0])]
    index = nearest.build(spark.createDataFrame(rows, "id long, embedding array<double>"), cells=9)
    assert index.n == len(points) and len(index.centers) == 9
    asked = index.rows.where("id % 10 = 0").select("id", "v")
    exact = {}
    for r in nearest.search(index, asked, 5, 9, others_only=True).collect():
        exact.setdefault(r["query"], []).append((r["rank"], r["id"]))
    for q, found in exact.items():
        d = ((points - points[q]) ** 2).sum(1)
        d[q] = np.inf
        assert [i for _, i in sorted(found)] == np.argsort(d, kind="stable")[:5].tolist()
    few = nearest.recall(nearest.search(index, asked, 5, 3), nearest.search(index, asked, 5, 9)).first()
    assert few.wanted == 5 * len(exact) and 0.5 * few.wanted < few.hit <= few.wanted
    assert 1 <= nearest.tuned(index, 5) <= 9 and nearest.build(spark.createDataFrame(rows[-2:-1], "id long, embedding array<double>")) is None


def test_a_stored_row_without_status_is_known(spark):
    stored = spark.createDataFrame([(1, "ingested"), (2, None)], "k int, status string")
    found = spark.createDataFrame([(1,), (2,), (3,), (3,)], "k int")
    assert sorted(tuple(r) for r in incremental.find_or_insert(stored, found, ["k"]).select("k", "status", "was_new").collect()) == [(1, "ingested", False), (2, "pending", False), (3, "pending", True)]


def test_neighbour_lists_hold_each_edge_once(spark, monkeypatch):
    monkeypatch.setattr(layout, "LIST", 8)
    edges = [(a, b) for a in range(40) for b in (a + 1, 0)]
    lists = layout._lists(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((a, r.b) for r in lists for a in r.near) == sorted(edges)
    assert max(len(r.near) for r in lists) < 20 and sum(r.b == 0 for r in lists) > 1


def test_layout_keeps_neighbours(spark):
    """Nine groups in nine dimensions, which two principal components fold over each other. New points land in their group."""
    rng = np.random.default_rng(9)
    points = np.concatenate([rng.normal(4 * np.eye(9)[k], 0.4, (20, 9)) for k in range(9)])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(points)] + [(999, None)], "id long, embedding array<double>")
    at = layout.neighbour_layout(df, rounds=12)
    flat = clusters.principal_layout(df).select("id", F.col("p0").alias("x"), F.col("p1").alias("y"))
    shares = [r.hit / r.wanted for r in (layout.kept(df, where, F.col("id") % 3 == 0).first() for where in (at, flat))]
    assert at.count() == len(points) and shares[0] > 0.3 and shares[0] > 1.5 * shares[1]
    index = nearest.build(df)
    fresh = spark.createDataFrame([(1000 + k, [float(x) for x in 4 * np.eye(9)[k]]) for k in range(9)], "id long, v array<double>")
    where = {r.id: np.array([r.x, r.y]) for r in at.collect()}
    centers = np.array([np.mean([where[i] for i in range(20 * k, 20 * k + 20)], 0) for k in range(9)])
    for r in layout.placed(index, at, fresh).collect():
        assert np.argmin(((centers - [r.x, r.y]) ** 2).sum(1)) == r.id - 1000
