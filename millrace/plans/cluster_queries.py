"""Queries of series, clusters and the map."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import clusters, continuity, density, layout, nearest, series
from millrace.plans.models import HITS_SQL, MEMBERS_SQL, hits, members, query_vector
from millrace.plans.registry import load, query

WEEK = "cast(date_trunc('week', day) as date)"
STOPS = "', '".join(series.STOPWORDS)


@query(f"""
    with m as ({MEMBERS_SQL}), w as (select cluster, {WEEK} as week_start, * exclude (cluster) from m),
    p as (select cluster, week_start, paper, count(*) as n from w group by 1, 2, 3), b as (select cluster, week_start, string_agg(paper || '=' || n, ',' order by paper) as by_paper from p group by 1, 2)
    select cluster, week_start, cast(count(*) as bigint) as members, any_value(by_paper) as by_paper, round(avg(quality) + 1e-9, 4) as mean_quality, round(avg(x) + 1e-9, 4) as x, round(avg(y) + 1e-9, 4) as y
    from w join b using (cluster, week_start) group by 1, 2""")
def weekly_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.weekly(members(spark, sf_dir))
    by_paper = F.array_join(F.transform(F.map_entries("by_paper"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("cluster", "week_start", "members", by_paper.alias("by_paper"), *(F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("mean_quality", "x", "y")))


@query(f"with m as ({MEMBERS_SQL}), w as (select cluster, {WEEK} as week_start, count(*) as n from m group by 1, 2) select cluster, round(stddev_pop(n) / avg(n), 6) as burstiness, cast(count(*) as bigint) as n_weeks, cast(sum(n) as bigint) as members from w group by 1")
def weekly_burstiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.burstiness(members(spark, sf_dir)).select("cluster", F.round("burstiness", 6).alias("burstiness"), "n_weeks", "members")


TEXTS_SQL = "select doc_id, cast(doc_id % 6 as integer) as cluster, date '2024-01-01' + cast(doc_id % 28 as integer) as day, text from documents"


@query(f"""
    with d as ({TEXTS_SQL}), w as (select cluster, {WEEK} as week_start, text from d),
    t as (select cluster, week_start, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{3,}}'), lambda x: x not in ('{STOPS}'))) as term from w),
    c as (select cluster, week_start, term, count(*) as n from t group by 1, 2, 3), f as (select cluster, term, sum(n) as f from c group by 1, 2),
    a as (select cluster, sum(n) as tokens from c group by 1), k as (select cluster, count(distinct week_start) as weeks from w group by 1),
    s as (select cluster, week_start, term, n, round(n * ln(1 + tokens / weeks / f), 9) as score from c join f using (cluster, term) join a using (cluster) join k using (cluster) where n >= 2),
    r as (select *, row_number() over (partition by cluster, week_start order by score desc, term desc) as place from s)
    select cluster, week_start, place, term, n, round(score, 5) as score from r where place <= 5""")
def weekly_distinctive_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c-TF-IDF within each cluster."""
    d = load(spark, sf_dir, "documents")
    rows = d.select(F.pmod("doc_id", F.lit(6)).cast("int").alias("cluster"), F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(28)).cast("int")).alias("day"), "text")
    return series.distinctive_terms(rows).select("cluster", "week_start", F.col("place").cast("long").alias("place"), "term", "n", F.round("score", 5).alias("score"))


DRIFT_SQL = f"""
    m as (select cast(label % 5 as integer) as cluster, cast(ts as date) + cast(vec_id % 4 as integer) * 7 as day, embedding::double[] as v from embeddings join events on vec_id = event_id),
    e as (select cluster, {WEEK} as week_start, unnest(v) as x, generate_subscripts(v, 1) as i from m), a as (select cluster, week_start, i, avg(x) as x, count(*) as n from e group by 1, 2, 3),
    c as (select cluster, week_start, list(x order by i) as v, max(n) as n from a group by 1, 2),
    l as (select *, lag(v) over (partition by cluster order by week_start) as before from c),
    d as (select cluster, coalesce(sum(1 - greatest(-1, least(1, list_cosine_similarity(before, v)))), 0) as path, arg_min(v, week_start) as p, arg_max(v, week_start) as q, count(*) as n_weeks, sum(n) as members from l group by 1),
    r as (select cluster, path, 1 - greatest(-1, least(1, list_cosine_similarity(p, q))) as net, n_weeks, members from d)
"""


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").join(load(spark, sf_dir, "events").select("event_id", "ts"), F.col("vec_id") == F.col("event_id"))
    spread = F.date_add(F.to_date("ts"), F.pmod("vec_id", F.lit(4)).cast("int") * 7)
    return series.drift(series.weekly_centroids(rows.select(F.pmod("label", F.lit(5)).cast("int").alias("cluster"), spread.alias("day"), "embedding")))




@query(f"with {DRIFT_SQL} select cluster, round(path, 6) as path, round(net, 6) as net, case when path > 1e-9 then round(least(1, net / path), 6) end as ratio, cast(n_weeks as bigint) as n_weeks, cast(members as bigint) as members from r")
def semantic_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift(spark, sf_dir).select("cluster", *(F.round(c, 6).alias(c) for c in ("path", "net", "ratio")), "n_weeks", "members")


@query(f"with {DRIFT_SQL} select cluster, round(net, 6) as net from r where members >= 30 order by net desc limit 3")
def strongest_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.strongest_drift(_drift(spark, sf_dir), most=3).select("cluster", F.round("net", 6).alias("net"))


@query(f"with m as ({MEMBERS_SQL}) select distinct day, paper from m")
def explore_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates on which a paper has members."""
    return members(spark, sf_dir).select("day", "paper").distinct()


CENTER_SQL = """
    e as (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings where label <> 0), a as (select label, i, avg(x::double) as x, count(*) as n from e group by 1, 2),
    c as (select label, list(x order by i) as v, max(n) as size from a group by 1)
"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with label 0 as noise."""
    e = load(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.when(F.col("label") == 0, clusters.NOISE).otherwise(F.col("label")).alias("label"), "embedding")


@query(f"with {CENTER_SQL} select label, cast(size as bigint) as size, i, round(v[i], 6) as v from (select *, unnest(generate_series(1, len(v))) as i from c)")
def cluster_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clusters.centroids(_members(spark, sf_dir))
    return c.select("label", "size", F.posexplode("centroid").alias("i", "v")).select("label", "size", (F.col("i") + 1).cast("long").alias("i"), F.round("v", 6).alias("v"))


@query(f"with {CENTER_SQL}, l as (select label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from c) select label, i, round(v[i] / n, 6) as v from (select *, unnest(generate_series(1, len(v))) as i from l)")
def unit_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clusters.centroids(_members(spark, sf_dir), unit=True)
    return c.select("label", F.posexplode("centroid").alias("i", "v")).select("label", (F.col("i") + 1).cast("long").alias("i"), F.round("v", 6).alias("v"))


@query(f"""
    with {CENTER_SQL}, u as (select label % 3 as parent, size, unnest(v) as x, generate_subscripts(v, 1) as i from c)
    select cast(parent as integer) as parent, cast(sum(size) as bigint) as size, i, round(sum(x * size) / sum(size), 6) as v from u group by 1, 3""")
def rolled_up_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids of an upper tier, weighted by the size of the leaves."""
    c = clusters.centroids(_members(spark, sf_dir)).withColumn("parent", F.col("label") % 3)
    out = clusters.rolled_up(c, "parent")
    return out.select("parent", "size", F.posexplode("centroid").alias("i", "v")).select("parent", "size", (F.col("i") + 1).cast("long").alias("i"), F.round("v", 6).alias("v"))


def _reps(order: str, most: int) -> str:
    return f"with {CENTER_SQL}, d as (select vec_id as id, e2.label, round({order}, 9) as distance from embeddings e2 join c on e2.label = c.label), r as (select *, row_number() over (partition by label order by distance, id) as place from d) select label, id, place, round(distance, 6) as distance from r where place <= {most}"


@query(_reps("list_distance(embedding::double[], v)", 8))
def cluster_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _members(spark, sf_dir)
    out = clusters.representatives(m.where("label >= 0"), clusters.centroids(m), 8)
    return out.select("label", "id", F.col("place").cast("long").alias("place"), F.round("distance", 6).alias("distance"))


@query(_reps("1 - greatest(-1, least(1, list_cosine_similarity(embedding::double[], v)))", 5))
def nearest_by_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _members(spark, sf_dir)
    out = clusters.representatives(m.where("label >= 0"), clusters.centroids(m), 5, metric="cosine")
    return out.select("label", "id", F.col("place").cast("long").alias("place"), F.round("distance", 6).alias("distance"))


@query("""
    with s as (select label, label % 3 as parent, count(*) as size from embeddings where label <> 0 group by 1),
    w as (select *, sum(size) over (partition by parent) as all_, row_number() over (partition by parent order by size desc, label) as rn from s),
    g as (select *, least(size, greatest(case when rn <= 3 then 1 else 0 end, cast(round_even(12 * size / all_, 0) as bigint))) as wanted from w where all_ >= 20),
    b as (select *, coalesce(sum(wanted) over (partition by parent order by size desc, label rows between unbounded preceding and 1 preceding), 0) as before from g)
    select cast(parent as integer) as parent, label, cast(greatest(0, least(wanted, 12 - before)) as integer) as share from b where greatest(0, least(wanted, 12 - before)) > 0""")
def proportional_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many representatives each leaf gives to its parent."""
    leaves = _members(spark, sf_dir).where("label >= 0").groupBy("label").agg(F.count(F.lit(1)).alias("size")).withColumn("parent", F.col("label") % 3)
    return clusters.proportional_shares(leaves, "parent", 12).select("parent", "label", "share")


TIER_SQL = "select event_id, cast(user_id % 8 as integer) as t0, cast(user_id % 4 as integer) as t1, cast(user_id % 2 as integer) as t2 from events"


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return load(spark, sf_dir, "events").select("event_id", *((u % k).cast("int").alias(n) for n, k in (("t0", 8), ("t1", 4), ("t2", 2))))


@query(f"select event_id, cast(unnest([0, 1, 2]) as integer) as tier, unnest([t0, t1, t2]) as label from ({TIER_SQL})")
def tier_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.tiered(_tiers(spark, sf_dir), ["t0", "t1", "t2"])


@query(f"select distinct t0, t1 from ({TIER_SQL})")
def tier_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.tier_links(_tiers(spark, sf_dir), "t0", "t1")


@query("select cast(case label when 0 then -1 else label end as integer) as label, cast(count(*) as bigint) as n from embeddings group by 1")
def size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.size_histogram(_members(spark, sf_dir))


@query(f"with m as ({MEMBERS_SQL}) select cluster as label, cast(count(*) as bigint) as size, min(day) as first_day, max(day) as last_day from m group by 1")
def cluster_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.extent(members(spark, sf_dir).withColumnRenamed("cluster", "label"))


GEOMETRY_SQL = "select event_id, value as x, user_id as y, cast(user_id % 8 as integer) as t0, cast(user_id % 4 as integer) as t1 from events where event_type <> 'error' and event_id % 5 <> 0"


@query(f"with g as ({GEOMETRY_SQL}), u as (select 0 as tier, t0 as label, x, y from g union all select 1, t1, x, y from g) select cast(tier as integer) as tier, label, cast(count(*) as bigint) as n_active, round(avg(x), 6) as x, round(avg(y), 6) as y from u group by 1, 2 union all select 0, 99, 0, 0, 0")
def active_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of the active content members of every cluster; an empty cluster goes to zero."""
    e = load(spark, sf_dir, "events")
    m = e.select(
        "event_id", F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"), (F.col("user_id") % 8).cast("int").alias("t0"), (F.col("user_id") % 4).cast("int").alias("t1"),
        F.when(F.col("event_type") == "error", "quarantined").otherwise("active").alias("status"), F.when(F.col("event_id") % 5 == 0, 1).otherwise(0).alias("content_type"),
    )
    known = spark.createDataFrame([(0, k) for k in (*range(8), 99)] + [(1, k) for k in range(4)], "tier int, label int")
    out = clusters.with_geometry(known.withColumns({c: F.lit(7) for c in ("n_active", "x", "y")}), clusters.active_geometry(m, ["t0", "t1"]))
    return out.select("tier", "label", "n_active", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("""
    with r as (select event_type, case when user_id % 10 = 0 then -1 else user_id % 7 end as label from events), s as (select event_type, label, count(*) as n from r group by 1, 2)
    select event_type, cast(count(*) filter (label <> -1) as bigint) as n_clusters, round(sum(case when label = -1 then n else 0 end) / sum(n), 6) as noise, cast(quantile_cont(n, 0.5) filter (label <> -1) as double) as median_size from s group by 1""")
def sweep_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = load(spark, sf_dir, "events").select("event_type", F.when(F.col("user_id") % 10 == 0, clusters.NOISE).otherwise(F.col("user_id") % 7).alias("label"))
    return clusters.sweep_metrics(runs, ["event_type"]).select("event_type", "n_clusters", F.round("noise", 6).alias("noise"), "median_size")


@query(f"""
    with {CENTER_SQL}, d as (select vec_id as id, c.label, round(1 - greatest(-1, least(1, list_cosine_similarity(embedding::double[], v))), 9) as distance from embeddings cross join c),
    n as (select *, row_number() over (partition by id order by distance, label) as rn from d)
    select id, label, round(distance, 6) as distance, distance > 0.8 as emerging from n where rn = 1""")
def frozen_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest frozen centroid of every point, or emerging."""
    m = _members(spark, sf_dir)
    return clusters.assign(m, clusters.centroids(m), 0.8).withColumn("distance", F.round("distance", 6))


@query("select 'src' || s as name, s as k, size from (select cast(replace(source, 'src', '') as integer) as s, cast(count(*) as bigint) as size from documents group by 1) where ('src' || s) like '%src1%'")
def topic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics whose label holds a text."""
    t = load(spark, sf_dir, "documents").groupBy(F.col("source").alias("label")).agg(F.count(F.lit(1)).alias("size"))
    return clusters.topic_search(t, "SRC1").select(F.col("label").alias("name"), F.replace("label", F.lit("src"), F.lit("")).cast("int").alias("k"), "size")


@query("select event_id as id, round((value - 100) * (value - 100) + (user_id - 50) * (user_id - 50), 6) as d2 from events where (value - 100) * (value - 100) + (user_id - 50) * (user_id - 50) <= 196 order by d2, id limit 1")
def nearest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("value").alias("x"), F.col("user_id").alias("y"))
    return clusters.nearest_point(e, 100.0, 50.0).select("id", F.round("d2", 6).alias("d2"))


@query("select min(value) as x_min, max(value) as x_max, cast(min(user_id) as bigint) as y_min, cast(max(user_id) as bigint) as y_max, cast(count(*) as bigint) as n from events where event_type in ('view', 'click')")
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    return clusters.bounding_box(e.select(F.col("value").alias("x"), F.col("user_id").alias("y")))


@query("select event_id as id, round((value - (select min(value) from events)) / ((select max(value) from events) - (select min(value) from events)), 6) as x, cast(0.5 as double) as y from events")
def scaled_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates on [0, 1]; 0.5 where all are equal."""
    e = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("value").alias("x"), F.lit(3.0).alias("y"))
    return clusters.scaled_layout(e).withColumn("x", F.round("x", 6))


@query("""
    with c as (select user_id % 12 as leaf, count(*) as size from events group by 1), r as (select case when leaf < 5 then 'a' else 'b' end as parent, 'topic ' || leaf as name, size from c)
    select parent, name, cast(size as bigint) as size, row_number() over (partition by parent order by size desc, name) as place from r""")
def drill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics below the theme that holds their first leaf."""
    parents = spark.createDataFrame([("a", list(range(5))), ("b", list(range(5, 12)))], "name string, leaves array<bigint>")
    c = load(spark, sf_dir, "events").groupBy((F.col("user_id") % 12).alias("leaf")).agg(F.count(F.lit(1)).alias("size"))
    children = c.select(F.concat(F.lit("topic "), F.col("leaf").cast("string")).alias("name"), F.array("leaf").alias("leaves"), "size")
    return clusters.drill_down(parents, children).withColumn("place", F.col("place").cast("long"))


@query("select user_id, case when user_id % 3 = 0 then '1,2' when user_id % 3 = 1 then '2,5' else '' end as in_focus from (select distinct user_id from events)")
def focus_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves in focus: isolation and search together, or the one that is set."""
    k = F.col("user_id") % 3
    u = load(spark, sf_dir, "events").select("user_id").distinct()
    isolated = F.when(k == 0, F.array(F.lit(1), F.lit(2), F.lit(3)))
    searched = F.when(k == 0, F.array(F.lit(1), F.lit(2))).when(k == 1, F.array(F.lit(2), F.lit(5)))
    return u.select("user_id", F.coalesce(F.array_join(F.transform(clusters.focus(isolated, searched), lambda x: x.cast("string")), ","), F.lit("")).alias("in_focus"))


@query("select cast(floor(vec_id / 1000) as bigint) as block, string_agg(cast(vec_id as varchar), ',' order by vec_id) as ids, string_agg(cast(label as varchar), ',' order by vec_id) as labels from embeddings group by 1")
def map_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel arrays in id order, in blocks of ids, of all points of a map."""
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    rows = clusters.map_export(e)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return rows.select("block", joined(F.col("id")).alias("ids"), joined(F.col("label")).alias("labels"))


@query("select event_type as color, cast(count(*) as bigint) as n, cast(sum(event_id) as bigint) as id_sum from events group by 1")
def points_by_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("color")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"))


@query("""
    with c as (select o_orderpriority as k, month(o_orderdate) as period, year(o_orderdate) as y, count(*) as n from orders group by 1, 2, 3),
    w as (select *, avg(n) over w as m, stddev_samp(n) over w as s from c window w as (partition by k, period order by y rows between unbounded preceding and 1 preceding))
    select k, cast(period as integer) as period, cast(y as integer) as y, cast(n as bigint) as n, case when s > 0 then round((n - m) / s, 6) end as z from w""")
def seasonal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z-score of a month against the same month of earlier years."""
    o = load(spark, sf_dir, "orders")
    c = o.groupBy(F.col("o_orderpriority").alias("k"), F.month("o_orderdate").alias("period"), F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return series.seasonal_score(c, ["k"], "period", "y").withColumn("z", F.round("z", 6))


@query("with c as (select source, lang, count(*) as n from documents group by 1, 2) select source, lang, cast(n as bigint) as n, round(n / sum(n) over (partition by source), 6) as share from c")
def group_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts as shares of their group, so that groups of different size compare."""
    c = load(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return series.shares(c, "source").withColumn("share", F.round("share", 6))


def _blobs(n: int = 40, dims: int = 8) -> pd.DataFrame:
    """Three tight groups and some noise, seeded."""
    rng = np.random.default_rng(7)
    centers = np.eye(dims)[:3] * 2
    points = np.concatenate([rng.normal(c, 0.02, (n, dims)) for c in centers] + [rng.uniform(-3, 3, (20, dims))])
    return pd.DataFrame({"id": range(len(points)), "embedding": [[float(v) for v in p] for p in points]})


@query()
def hdbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters of all vectors by a mutual reachability tree that is grown in rounds; rows without a vector are noise."""
    points = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    tree = density.spanning_tree(points)
    found = density.clusters(tree, 15) if tree else spark.createDataFrame([], "id long, label int")
    return density.labelled(points, found)


@query()
def density_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusterings of all vectors by least cluster size, ranked by density validity, NaN last."""
    points = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    runs = list(density.sweep(spark, points, [5, 15, 30, 60], density.spanning_tree(points)))
    rows = spark.createDataFrame([tuple(r.values()) for r in runs], "min_cluster_size int, n_clusters long, noise double, median_size double, dbcv double")
    worth = F.when(~F.isnan("dbcv"), F.col("dbcv")).desc_nulls_last()
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(worth, "min_cluster_size")))


def _neighbours(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The ten nearest chunks by cosine distance of each vector whose id is divisible by 50: by the inverted file, and exactly."""
    index = nearest.build(nearest.unit(load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")))
    asked = index.rows.where("id % 50 = 0").select("id", "v")
    return nearest.search(index, asked, 10, nearest.tuned(index, 10)), nearest.search(index, asked, 10, len(index.centers))


@query()
def approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest neighbours from an inverted-file index; `neighbour_recall` measures them."""
    found, _ = _neighbours(spark, sf_dir)
    return found.select("query", "id", F.round(F.col("distance") ** 2 / 2, 6).alias("distance"), "rank")


@query("""
    with q as (select vec_id as query, embedding::double[] as qv from embeddings where vec_id % 50 = 0)
    select query, vec_id as id, round(1 - list_cosine_similarity(qv, embedding::double[]), 6) as distance, cast(row_number() over (partition by query order by list_cosine_similarity(qv, embedding::double[]) desc, vec_id) as integer) as rank
    from q, embeddings where embedding is not null qualify rank <= 10""")
def exact_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact leg: all cells are probed."""
    _, exact = _neighbours(spark, sf_dir)
    return exact.select("query", "id", F.round(F.col("distance") ** 2 / 2, 6).alias("distance"), "rank")


@query("select cast(sum(least(10, (select count(*) from embeddings where embedding is not null))) as bigint) as wanted, true as enough from embeddings where vec_id % 50 = 0 and embedding is not null")
def neighbour_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many neighbours there are to find, and whether the index finds nine in ten or more."""
    return nearest.recall(*_neighbours(spark, sf_dir)).select("wanted", (F.col("hit") >= 0.9 * F.col("wanted")).alias("enough"))


@query()
def ward_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested cuts of a Ward linkage over unit centroids."""
    return clusters.hierarchy(clusters.centroids(_members(spark, sf_dir), unit=True), [2, 4], "ward")


@query()
def average_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested cuts of an average linkage by cosine distance."""
    return clusters.hierarchy(clusters.centroids(_members(spark, sf_dir)), [5, 3], "average")


@query()
def principal_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two principal components: the declared substitute for a manifold layout."""
    out = clusters.principal_layout(_members(spark, sf_dir))
    return out.select("id", *(F.round(F.abs(c), 6).alias(c) for c in ("p0", "p1")))


@query("""
    with m as (select vec_id % 25 as thread, vec_id, embedding::double[] as v, row_number() over (partition by vec_id % 25 order by vec_id) as pos, count(*) over (partition by vec_id % 25) as n from embeddings where embedding is not null),
    d as (select thread, pos, (case when pos = 1 then 1 else 0.3 end) * power(0.7::double, n - pos) as w, unnest(v) as x, generate_subscripts(v, 1) as i from m),
    e as (select thread, list(s order by i) as ema, list(f order by i) as first from (select thread, i, sum(w * x) as s, max(x) filter (pos = 1) as f from d group by 1, 2) group by 1)
    select thread, round(1 - list_cosine_similarity(ema, first), 6) as drift from e""")
def moving_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential moving centroid of each thread and its distance to the first vector."""
    m = load(spark, sf_dir, "embeddings").select((F.col("vec_id") % 25).alias("thread"), "vec_id", "embedding")
    return series.moving_centroid(m, "thread", "vec_id", "embedding").select("thread", F.round("drift", 6).alias("drift"))


@query(f"""
    with m as (select label, i, avg(x) as x from (select label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as i from embeddings where embedding is not null) group by 1, 2),
    c as (select label, list(x order by i) as c from m group by 1), q as (select embedding::double[] as q from embeddings where vec_id = 0),
    h as (select label, count(*) as hits from embeddings join ({HITS_SQL}) on doc_id = vec_id group by 1),
    s as (select label, round(list_cosine_similarity(c, q), 9) as similarity, coalesce(hits, 0) as hits from c cross join q left join h using (label)),
    r as (select *, round(0.7 * greatest(similarity, 0) + 0.3 * coalesce(ln(1 + hits) / nullif(ln(1 + max(hits) over ()), 0), 0), 9) as score from s)
    select label, round(similarity, 6) as similarity, cast(hits as bigint) as hits, round(score, 6) as score, cast(row_number() over (order by score desc, label) as integer) as rank,
           round(score - lead(score) over (order by score desc, label), 6) as margin, first_value(score) over (order by score desc, label) < 0.5 as weak
    from r qualify row_number() over (order by score desc, label) <= 8""")
def question_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics for a question: centroids and full-text hits, blended."""
    e = load(spark, sf_dir, "embeddings").where("embedding is not null")
    centers = clusters.centroids(e.select("label", "embedding"))
    found = e.select(F.col("vec_id").alias("chunk_id"), "label").join(hits(spark, sf_dir), "chunk_id").groupBy("label").agg(F.count(F.lit(1)).alias("hits"))
    out = continuity.question_clusters(centers, query_vector(spark, sf_dir), found)
    return out.withColumns({c: F.round(c, 6) for c in ("similarity", "score", "margin")})


@query()
def cluster_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of one half of the vectors matched to those of the other half, a label of which falls into two and two of which are one."""
    e = load(spark, sf_dir, "embeddings").where("embedding is not null")
    old = clusters.centroids(e.where("vec_id % 2 = 0").select("label", "embedding"))
    fresh = F.when((F.col("label") == 3) & (F.col("vec_id") % 4 == 1), 100).when(F.col("label") == 5, 4).otherwise(F.col("label"))
    new = clusters.centroids(e.where("vec_id % 2 = 1").select(fresh.cast("int").alias("label"), "embedding"))
    return continuity.continuity(old, new, 0.5).withColumn("similarity", F.round("similarity", 6))


@query()
def neighbour_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of all vectors that keeps more of their neighbours than principal components do; a test measures it."""
    points = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return layout.neighbour_layout(points).select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))
