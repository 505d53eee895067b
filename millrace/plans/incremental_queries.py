"""Queries of incremental work, sources and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import incremental
from millrace.plans.registry import load, query
from millrace.sources import documents, manifests
from millrace.streaming import jobs


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as downloads: eleven to a URL, texts as bodies, a fifth of them policies."""
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "policy").otherwise("other").alias("doc_type"), F.concat(F.lit("u"), F.floor(F.col("doc_id") / 11).cast("string")).alias("source_url"), F.md5("text").alias("sha256"))


ENTRIES_SQL = "select doc_id, case when doc_id % 5 = 0 then 'policy' else 'other' end as doc_type, 'u' || cast(floor(doc_id / 11) as integer) as source_url, md5(text) as sha256 from documents"


@query(f"""
    with e as ({ENTRIES_SQL}), r as (select *, row_number() over (partition by source_url order by doc_id) as u, row_number() over (partition by doc_type, source_url, sha256 order by doc_id) as b from e),
    k as (select *, case when doc_type = 'policy' then b > 1 else u > 1 end as skipped from r),
    f as (select *, row_number() over (partition by sha256 order by doc_id) as h from k where not skipped)
    select doc_id, 'skipped' as fate from k where skipped union all select doc_id, case when doc_type <> 'policy' and h > 1 then 'recorded' else 'stored' end from f""")
def download_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """De-duplication by URL, by body, and for policies by both."""
    return incremental.manifest_status(_entries(spark, sf_dir), ["doc_id"]).select("doc_id", "fate")


@query(f"select source_url, doc_id, sha256 from (select *, row_number() over (partition by source_url order by doc_id) as rn from ({ENTRIES_SQL})) where rn = 1")
def first_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.first_seen(_entries(spark, sf_dir), ["source_url"], ["doc_id"]).select("source_url", "doc_id", "sha256")


@query("""
    with o as (select s_suppkey as k, s_name as name, s_acctbal as amount from supplier), n as (select case when s_suppkey % 5 = 1 then -s_suppkey else s_suppkey end as k, case when s_suppkey % 2 = 0 then 'new ' || s_name end as name, cast(s_nationkey as double) as amount from supplier)
    select coalesce(o.k, n.k) as k, coalesce(n.name, o.name) as name, coalesce(n.amount, o.amount) as amount from o full outer join n using (k)""")
def upsert_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New values over old ones; a null keeps the old. Every fifth supplier comes back under a key that isn't stored."""
    s = load(spark, sf_dir, "supplier")
    old = s.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("amount"))
    new = s.select(F.when(F.col("s_suppkey") % 5 == 1, -F.col("s_suppkey")).otherwise(F.col("s_suppkey")).alias("k"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("new "), F.col("s_name"))).alias("name"), F.col("s_nationkey").cast("double").alias("amount"))
    return incremental.upsert(old, new, ["k"])


@query("select l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity from (select *, row_number() over (partition by l_partkey, l_suppkey order by l_orderkey * 10 + l_linenumber desc) as rn from lineitem) where rn = 1")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On a key conflict the last written row replaces all."""
    rows = load(spark, sf_dir, "lineitem").withColumn("seq", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return incremental.last_wins(rows, ["l_partkey", "l_suppkey"], "seq").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")


@query("select c_custkey, case when c_custkey % 4 = 0 then 'ingested' else 'pending' end as status, c_custkey % 4 <> 0 as was_new from customer")
def find_or_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select("c_custkey")
    stored = c.where("c_custkey % 4 = 0").withColumn("status", F.lit("ingested"))
    return incremental.find_or_insert(stored, c.unionByName(c), ["c_custkey"])


@query("select distinct o_custkey from orders where o_custkey not in (select c_custkey from customer where c_nationkey < 12)")
def insert_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key isn't stored, once each."""
    stored = load(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("o_custkey"))
    return incremental.new_rows(load(spark, sf_dir, "orders").select("o_custkey"), stored, ["o_custkey"])


@query("select o_orderkey, o_totalprice from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = load(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return incremental.without(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), gone, ["o_custkey"]).select("o_orderkey", "o_totalprice")


@query("select s_suppkey, s_name, case when n_regionkey = 1 then -1.0 else s_acctbal end as s_acctbal from supplier join nation on s_nationkey = n_nationkey")
def bulk_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values replaced through a joined table of updates."""
    s = load(spark, sf_dir, "supplier")
    region = load(spark, sf_dir, "nation").where("n_regionkey = 1")
    updates = s.join(region, s.s_nationkey == region.n_nationkey, "left_semi").select("s_suppkey", F.lit(-1.0).alias("s_acctbal"))
    return incremental.replaced(s.select("s_suppkey", "s_name", "s_acctbal"), updates, ["s_suppkey"])


@query("select l_orderkey, max(l_linenumber) + 1 as next_index from lineitem group by 1")
def next_chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.next_index(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


RESUME_SQL = """
    d as (select o_orderkey as id, 's' || o_custkey % 9 as slug, case when o_orderkey % 7 <> 0 then cast(o_orderdate as date) end as day, case when o_orderstatus = 'P' then 'pending' else 'ingested' end as status, case when o_orderkey % 3 = 0 then 1 end as processed_at from orders),
    c as (select distinct l_orderkey as id from lineitem where l_returnflag = 'R')
"""


def _resume(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = load(spark, sf_dir, "orders")
    d = o.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("s"), (F.col("o_custkey") % 9).cast("string")).alias("slug"), F.when(F.col("o_orderkey") % 7 != 0, F.to_date("o_orderdate")).alias("day"),
        F.when(F.col("o_orderstatus") == "P", "pending").otherwise("ingested").alias("status"), F.when(F.col("o_orderkey") % 3 == 0, 1).alias("processed_at"),
    )
    return d, load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_returnflag") == "R", "table").otherwise("prose").alias("kind"))


@query(f"with {RESUME_SQL} select id, slug, day from d where status = 'ingested' and processed_at is null and id not in (select id from c) order by slug, day desc nulls last, id limit 500")
def resumable_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingested, not processed, without a table chunk; newest first, undated last."""
    return incremental.resumable(*_resume(spark, sf_dir), "id", 500).select("id", "slug", "day")


@query(f"with {RESUME_SQL} select d.id, cast(case when c.id is not null then 9 else processed_at end as integer) as processed_at from d left join c using (id)")
def backfilled_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.backfill(*_resume(spark, sf_dir), "id", F.lit(9), "processed_at").select("id", "processed_at")


@query("""
    with o as (select doc_id, text from documents), n as (select case when doc_id % 7 = 0 then -1 - doc_id else doc_id end as doc_id, text from documents)
    select coalesce(o.doc_id, n.doc_id) as doc_id, case when o.doc_id is null then 'NEW' when n.doc_id is null then 'GONE' when n.doc_id % 5 = 0 then 'UPDATED' else 'UNCHANGED' end as change from o full outer join n on o.doc_id = n.doc_id""")
def text_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NEW, UNCHANGED, UPDATED or GONE by the normalised text's hash."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("ß"), F.lit("s")).alias("text"))
    new = d.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" more"))).otherwise(F.concat(F.lit("  "), F.upper("text"))))
    new = new.withColumn("doc_id", F.when(F.col("doc_id") % 7 == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id")))  # gone under the old id, new under another
    return incremental.changes(d, new, "doc_id", "text")


@query("select l_orderkey, l_linenumber, l_partkey, l_linenumber = max(l_linenumber) over (partition by l_orderkey) as is_current from lineitem")
def current_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return incremental.current_versions(rows, ["l_orderkey"], "l_linenumber")


@query("select n_nationkey, n_name from nation where exists (select 1 from customer where c_nationkey = n_nationkey and c_acctbal > 9800)")
def exists_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = load(spark, sf_dir, "customer").where("c_acctbal > 9800").select(F.col("c_nationkey").alias("n_nationkey"))
    return load(spark, sf_dir, "nation").select("n_nationkey", "n_name").join(rich, "n_nationkey", "left_semi")


@query("select n_nationkey, n_name from nation where not exists (select 1 from customer where c_nationkey = n_nationkey and c_acctbal > 9800)")
def not_exists_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = load(spark, sf_dir, "customer").where("c_acctbal > 9800").select(F.col("c_nationkey").alias("n_nationkey"))
    return load(spark, sf_dir, "nation").select("n_nationkey", "n_name").join(rich, "n_nationkey", "left_anti")


@query("select cast(user_id as bigint) as user_id, event_type, count(*) as n from events group by all")
def running_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query()
def rate_limited_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding-log limiter: refused calls aren't recorded, so the state recurs; tests replay it."""
    calls = load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "event_id")
    return incremental.rate_limited(calls, 86_400.0, 3).select("event_id", "key", "allowed")


@query(r"""
    with recursive t as (
        select doc_id, row_number() over (order by doc_id) as i, least(cast(floor(length(text) / 1.5) as integer) + 1, 32000) as n from documents where regexp_matches(coalesce(text, ''), '\S')),
    w as (
        select i, doc_id, n as tokens, 1 as inputs, 0 as batch from t where i = 1
        union all
        select t.i, t.doc_id, case when inputs >= 128 or tokens + n > 250000 then n else tokens + n end, case when inputs >= 128 or tokens + n > 250000 then 1 else inputs + 1 end,
               case when inputs >= 128 or tokens + n > 250000 then batch + 1 else batch end
        from w join t on t.i = w.i + 1)
    select doc_id, batch from documents left join w using (doc_id)""")
def packed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy requests by number of inputs and of estimated tokens, in one order over all."""
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    return incremental.packed(d, "doc_id").select("doc_id", "batch")


@query()
def html_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable text of pages, tables apart; tests use pages with tables."""
    out = documents.with_html(load(spark, sf_dir, "pages").select("page_id", "html"))
    return out.select("page_id", F.char_length("prose").alias("n_chars"), F.size("tables").alias("n_tables"), F.md5("prose").alias("prose_md5"))


@query()
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.with_links(load(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "target", "link_text")


@query(r"select page_id, unnest(regexp_extract_all('<urlset><url><loc> ' || url || ' </loc></url><LOC>http://b/' || page_id || '</LOC></urlset>', '(?i)<loc>\s*([^<\s]+)\s*</loc>', 1)) as loc from pages")
def sitemap_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = F.concat(F.lit("<urlset><url><loc> "), F.col("url"), F.lit(" </loc></url><LOC>http://b/"), F.col("page_id").cast("string"), F.lit("</LOC></urlset>"))
    return load(spark, sf_dir, "pages").select("page_id", F.explode(documents.sitemap_urls(xml)).alias("loc"))


@query("""
    with p as (select page_id, url from pages), e as (select 'http://h/' || a.page_id as url, 'http://h/' || (a.page_id * 2 + k) as target from p a cross join (select unnest([1, 2]) as k)),
    l0 as (select 'http://h/0' as url, 0 as depth), l1 as (select distinct target as url from e join l0 using (url) where target not in (select url from l0)),
    l2 as (select distinct target as url from e join l1 using (url) where target not in (select url from l0 union all select url from l1)),
    l3 as (select distinct target as url from e join l2 using (url) where target not in (select url from l0 union all select url from l1 union all select url from l2))
    select url, cast(0 as integer) as depth from l0 union all select url, 1 from l1 union all select url, 2 from l2 union all select url, 3 from l3""")
def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth-first frontier over known links, each page once with its depth."""
    p = load(spark, sf_dir, "pages").select("page_id")
    u = lambda c: F.concat(F.lit("http://h/"), c.cast("string"))
    edges = p.select(u(F.col("page_id")).alias("url"), F.explode(F.array(u(F.col("page_id") * 2 + 1), u(F.col("page_id") * 2 + 2))).alias("target"))
    return manifests.crawl(edges, spark.createDataFrame([("http://h/0",)], "url string"), 3, 10_000, "h")


@query(f"""
    with e as ({ENTRIES_SQL}), a as (select *, 0 as s from e where doc_id % 2 = 0 union all select *, 1 from e), r as (select *, row_number() over (partition by source_url, sha256 order by s, doc_id) as rn from a)
    select source_url, sha256 from r where rn = 1 and doc_type = 'other'""")
def gathered_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit and found manifests together: each URL and body once, filtered by type."""
    e = incremental.first_seen(_entries(spark, sf_dir), ["source_url", "sha256"], [F.col("doc_id") % 2, "doc_id"]).withColumn("district", F.lit("d"))
    return manifests.gathered([e.where("doc_id % 2 = 0"), e], doc_type="other").select("source_url", "sha256")


@query("select doc_id, lang from documents order by md5('7:' || doc_id), doc_id limit 100")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random sample that the seed alone decides."""
    return manifests.sampled(load(spark, sf_dir, "documents").select("doc_id", "lang"), 100, 7, "doc_id")


@query("select user_id, cast(date_trunc('week', ts) as date) as week_start, count(*) as n from events group by 1, 2")
def weekly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time weekly counts, here over the table; the same function runs on a stream in tests."""
    e = load(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return jobs.weekly_counts(e, "user_id")
