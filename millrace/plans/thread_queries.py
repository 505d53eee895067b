"""Queries of threads, coverage and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import continuity, threads
from millrace.plans.registry import load, query

LIFECYCLE = ["view", "click", "signup", "purchase", "error"]


@query("""
    with e as (select event_id as id, user_id as thread, ts, list_position(['view', 'click', 'signup', 'purchase', 'error'], event_type) as s from events),
    l as (select *, lag(s) over (partition by thread order by ts, id) as b from e)
    select id, thread from l where s < b""")
def events_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events at an earlier stage than the one before in their thread."""
    e = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("thread"), F.col("ts").alias("day"), F.col("event_type").alias("stage"))
    return threads.out_of_order(e, LIFECYCLE).select("id", "thread")


@query("""
    with l as (select user_id as thread, cast(max(ts) as date) as last_day, arg_max(event_type, (ts, event_id)) as stage from events group by 1)
    select thread, last_day from l where stage <> 'error' and date '2024-02-01' - last_day > 1""")
def quiet_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("thread"), "ts", F.when(F.col("event_type") == "error", "closed").otherwise(F.col("event_type")).alias("stage"))
    found = threads.quiet(e.select(F.col("event_id").alias("id"), "thread", F.col("ts").alias("day"), "stage"), F.lit("2024-02-01").cast("date"), 1)
    return found.select("thread", F.to_date("last_day").alias("last_day"))


@query("""
    with c as (select lang, doc_id % 3 = 0 or n_chars > 5000 as has from documents)
    select lang, cast(count(*) filter (has) as bigint) as covered, cast(count(*) as bigint) as claims, round(count(*) filter (has) / count(*), 6) as coverage from c group by 1""")
def evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("lang", F.when((F.col("doc_id") % 3 == 0) | (F.col("n_chars") > 5000), F.array(F.lit("e"))).alias("evidence"))
    return threads.coverage(d, "lang").withColumn("coverage", F.round("coverage", 6))


@query("""
    with e as (select event_id as id, cast(user_id % 10 as integer) as grp, cast(ts as date) as day, ['type ' || event_type, 'u' || user_id % 4] as entities from events where event_type = 'purchase'),
    t as (select user_id as thread, cast(user_id % 10 as integer) as grp, cast(min(ts) as date) + 5 as last_day, ['type purchase', 'u' || user_id % 4] as known from events group by user_id),
    m as (select id, e.grp, thread, 0.5 + 0.5 * len(list_intersect(entities, known)) / len(list_distinct(list_concat(entities, known))) as score from e join t on e.grp = t.grp and last_day <= day and day - last_day <= 14),
    r as (select *, row_number() over (partition by id order by round(score, 9) desc, thread) as place from m)
    select id, grp, thread, round(score, 6) as score, place from r where place <= 3""")
def thread_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent threads of an event's group by nearness; the range of days is an equality on periods."""
    e = load(spark, sf_dir, "events")
    u = F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string"))
    one = F.array(F.lit(1.0))
    found = e.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), (F.col("user_id") % 10).cast("int").alias("grp"), F.to_date("ts").alias("day"), one.alias("embedding"), F.array(F.concat(F.lit("type "), F.col("event_type")), u).alias("entities"))
    known = e.groupBy("user_id").agg(F.date_add(F.to_date(F.min("ts")), 5).alias("last_day")).select(
        (F.col("user_id") % 10).cast("int").alias("grp"), F.col("user_id").alias("thread"), "last_day", one.alias("centroid"), F.array(F.lit("type purchase"), u).alias("entities")
    )
    out = threads.shortlist(found, known, 14)
    return out.select("id", "grp", "thread", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query("""
    with s as (select event_type, user_id % k as label, k from events cross join (select unnest([3, 5, 8]) as k)), c as (select event_type, k, label, count(*) as n from s group by 1, 2, 3)
    select event_type, cast(k as integer) as k, cast(count(*) as bigint) as n_clusters, cast(quantile_cont(n, 0.5) as double) as median_size from c group by 1, 2""")
def sweep_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics over a grid of settings, all settings in one pass."""
    from millrace.operators import clusters

    runs = load(spark, sf_dir, "events").select("event_type", F.explode(F.array(F.lit(3), F.lit(5), F.lit(8))).alias("k"), "user_id").withColumn("label", F.col("user_id") % F.col("k"))
    return clusters.sweep_metrics(runs, ["event_type", "k"]).select("event_type", "k", "n_clusters", "median_size")


def _beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats of threads: orders, their customer as thread."""
    return load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("thread"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("grp"), F.date_format("o_orderdate", "yyyy-MM").alias("meeting"))


MERGES_SQL = "select c_custkey as from_thread, (c_custkey * 7 + c_nationkey) % (c_nationkey * 40 + 60) as to_thread, max(o_orderdate)::date as at_date from customer left join orders on o_custkey = c_custkey where c_mktsegment = 'BUILDING' group by 1, 2"


@query(f"""
    with recursive e as ({MERGES_SQL}), b as (select distinct o_custkey as thread, o_orderdate::date as day from orders),
    f as (select from_thread as x, min(to_thread) as y from e group by 1), w as (select x as s, y from f union select s, f.y from w join f on w.y = f.x)
    select distinct from_thread, to_thread, flag from (
        select from_thread, to_thread, 'cycle' as flag from e where from_thread in (select s from w where s = y)
        union all select from_thread, to_thread, 'orphan' from e where from_thread not in (select thread from b) or to_thread not in (select thread from b)
        union all select from_thread, to_thread, 'merged twice' from e where from_thread in (select from_thread from e group by 1 having count(*) > 1)
        union all select from_thread, to_thread, 'survivor quiet' from e where at_date is not null and not exists (select 1 from b where thread = to_thread and abs(day - at_date) <= 60))""")
def merge_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges of threads that can't be right: cycles, orphans, survivors without a beat."""
    c = load(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("from_thread"), ((F.col("c_custkey") * 7 + F.col("c_nationkey")) % (F.col("c_nationkey") * 40 + 60)).alias("to_thread"))
    last = _beats(spark, sf_dir).groupBy(F.col("thread").alias("from_thread")).agg(F.max("day").alias("at_date"))
    return continuity.merge_audit(c.join(last, "from_thread", "left"), _beats(spark, sf_dir).select("thread", "day"))


@query("""
    with f as (select o_custkey, o_orderpriority as grp, min((o_orderdate::date, strftime(o_orderdate, '%Y-%m')))[2] as meeting from orders group by 1, 2), c as (select grp, meeting, count(*) as started from f group by 1, 2)
    select grp, meeting, cast(started as bigint) as started, round(mean, 6) as mean from (select *, avg(started) over (partition by grp) as mean from c) where started > 1.5 * mean""")
def thread_explosions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meetings that start far more threads than their group's do in the mean."""
    return continuity.explosion(_beats(spark, sf_dir), "grp", "meeting", 1.5).withColumn("mean", F.round("mean", 6))


@query("with s as (select o_orderpriority as grp, o_custkey, count(*) as n from orders group by 1, 2) select grp, cast(count(*) as bigint) as threads, cast(count(*) filter (n = 1) as bigint) as single, round(count(*) filter (n = 1) / count(*), 6) as share from s group by 1")
def single_beat_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return continuity.single_beats(_beats(spark, sf_dir), "grp").withColumn("share", F.round("share", 6))


@query("""
    with c as (select date_trunc('week', ts)::date as week, user_id % 8 as grp, event_type as item, count(*) as n from events group by all),
    f as (select week, grp, item, coalesce(n, 0) as n from (select distinct week, grp from c) join (select distinct week, item from c) using (week) left join c using (week, grp, item)),
    w as (select *, sum(n) over (partition by week, grp) as own, sum(n) over (partition by week, item) as item_all, sum(n) over (partition by week) as period_all from f),
    r as (select *, n / own as p, case when period_all > own then (item_all - n) / (period_all - own) end as q from w)
    select week, grp, round(sum((case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2) filter (q is not null), 6) as divergence,
           cast(count(*) filter (n = 0 and q > 0) as bigint) as lacks, cast(count(*) filter (n > 0 and q = 0) as bigint) as alone from r group by 1, 2""")
def group_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each group's events of a week are from those of its peers."""
    e = load(spark, sf_dir, "events").groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week"), (F.col("user_id") % 8).alias("grp"), F.col("event_type").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return continuity.divergence(e, "grp", "item", "week").withColumn("divergence", F.round("divergence", 6))
