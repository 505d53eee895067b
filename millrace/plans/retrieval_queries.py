"""Queries of retrieval, evidence and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import fts, text
from millrace.operators import evaluation, retrieval
from millrace.plans.models import BARE_SQL, CHUNKS_SQL, DISTANCE_SQL, TOKENS_SQL, chunks, contents, hits, query_vector
from millrace.plans.registry import load, query

LEGS_SQL = f"""
    c as ({CHUNKS_SQL}),
    a as (select *, {DISTANCE_SQL} as distance from c where chunk_id <> 0),
    sem as (select *, row_number() over (partition by district order by distance, chunk_id) as rank from a),
    lex as (select *, row_number() over (partition by district order by score desc, chunk_id) as rank from a where score > 0),
    fused as (
        select district, chunk_id, sum(1.0::double / (60 + rank)) as rrf
        from (select district, chunk_id, rank from sem where rank <= 50 union all select district, chunk_id, rank from lex where rank <= 50) group by 1, 2)
"""


@query(f"""
    select district, chunk_id, rank, round(distance, 6) as distance from (
        select *, row_number() over (partition by district order by {DISTANCE_SQL}, chunk_id) as rank, {DISTANCE_SQL} as distance
        from ({CHUNKS_SQL}) where chunk_id <> 0) where rank <= 12""")
def panel_semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest chunks of each group."""
    rows = chunks(spark, sf_dir).where("chunk_id <> 0")
    out = retrieval.semantic_leg(rows, query_vector(spark, sf_dir), 12, "district")
    return out.select("district", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


@query(f"select district from (select distinct district from ({CHUNKS_SQL})) where district not in (select district from ({CHUNKS_SQL}) where {DISTANCE_SQL} < 0.72 and chunk_id <> 0)")
def panel_absent_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups without a chunk near the question."""
    all_ = chunks(spark, sf_dir)
    near = retrieval.semantic_leg(all_.where("chunk_id <> 0"), query_vector(spark, sf_dir), 1, "district").where("distance < 0.72")
    return retrieval.absent(all_, near)


@query(f"select chunk_id, round(distance, 6) as distance, row_number() over (order by distance, chunk_id) as rank from (select *, {DISTANCE_SQL} as distance from ({CHUNKS_SQL}) where chunk_id <> 0 order by distance, chunk_id limit 50)")
def global_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieval.semantic_leg(chunks(spark, sf_dir).where("chunk_id <> 0"), query_vector(spark, sf_dir), 50)
    return out.select("chunk_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"""
    with c as ({CHUNKS_SQL}), a as (select *, {DISTANCE_SQL} as distance from c where chunk_id <> 0),
    r as (select chunk_id, row_number() over (order by distance, chunk_id) as rank from a union all select chunk_id, row_number() over (order by score desc, chunk_id) from a where score > 0)
    select chunk_id, round(sum(1.0::double / (60 + rank)), 9) as rrf from r where rank <= 50 group by 1""")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank fusion of both legs over all."""
    rows = chunks(spark, sf_dir).where("chunk_id <> 0")
    legs = [retrieval.semantic_leg(rows, query_vector(spark, sf_dir), 50), retrieval.lexical_leg(rows, hits(spark, sf_dir), 50)]
    return retrieval.fuse(legs).select("chunk_id", F.round("rrf", 9).alias("rrf"))


@query(f"with {LEGS_SQL} select district, chunk_id, round(rrf, 9) as rrf, rank from (select *, row_number() over (partition by district order by round(rrf, 12) desc, chunk_id) as rank from fused) where rank <= 12")
def rrf_fuse_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).where("chunk_id <> 0")
    legs = [retrieval.semantic_leg(rows, query_vector(spark, sf_dir), 50, "district"), retrieval.lexical_leg(rows, hits(spark, sf_dir), 50, "district")]
    return retrieval.fuse(legs, 12, "district").select("district", "chunk_id", F.round("rrf", 9).alias("rrf"), F.col("fused_rank").cast("long").alias("rank"))


PANEL_SQL = f"""
    with {LEGS_SQL},
    pool as (select *, row_number() over (partition by district order by round(rrf, 12) desc, chunk_id) as rank from fused),
    docs as (select pool.*, document_id from pool join c using (chunk_id) where rank <= 12),
    o as (select *, row_number() over (partition by district, document_id order by rank) > 2 as overflow from docs),
    p as (select *, row_number() over (partition by district order by overflow, rank) as place from o)
    select {{}} from p where place <= 4"""


@query(PANEL_SQL.format("district, chunk_id, document_id, rank, overflow, place").replace("pool.*", "pool.district, pool.chunk_id, pool.rank"))
def panel_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and full text, fused, two chunks of a document at most, overflow as backfill."""
    rows = chunks(spark, sf_dir)
    evidence, _ = retrieval.panel(rows.where("chunk_id <> 0"), rows, query_vector(spark, sf_dir), hits(spark, sf_dir))
    return evidence.select("district", "chunk_id", "document_id", F.col("fused_rank").cast("long").alias("rank"), "overflow", F.col("place").cast("long").alias("place"))


@query(PANEL_SQL.format("row_number() over (order by district, place) as n, '[' || row_number() over (order by district, place) || '] ' || district || chr(10) || coalesce(case when length(content) > 1800 then content[1:1800] || ' …' else content end, '') as block").replace("pool.*", "pool.district, pool.chunk_id, pool.rank, text as content").replace("join c using (chunk_id)", "join c using (chunk_id) left join documents d on d.doc_id = chunk_id"))
def evidence_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence numbered across groups, as text for a prompt."""
    rows = chunks(spark, sf_dir)
    evidence, _ = retrieval.panel(rows.where("chunk_id <> 0"), rows, query_vector(spark, sf_dir), hits(spark, sf_dir))
    evidence = evidence.join(contents(spark, sf_dir), "chunk_id", "left").withColumn("content", F.coalesce("content", F.lit("")))
    blocks = retrieval.evidence_text(evidence)
    return blocks.select(F.col("n").cast("long").alias("n"), "block")


@query(f"""
    with c as ({CHUNKS_SQL}), a as (select *, {DISTANCE_SQL} as distance from c where chunk_id <> 0),
    r as (select chunk_id, row_number() over (order by distance, chunk_id) as rank from a union all select chunk_id, row_number() over (order by score desc, chunk_id) from a where score > 0),
    f as (select chunk_id, sum(1.0::double / (60 + rank)) as rrf from r where rank <= 50 group by 1),
    p as (select chunk_id, row_number() over (order by round(rrf, 12) desc, chunk_id) as fused_rank from f),
    s as (select p.*, coalesce(a.score, 0) + 10 * (1 - round(distance, 6)) as total from p join a using (chunk_id) where fused_rank <= 20)
    select chunk_id, row_number() over (order by total desc, fused_rank) as final_rank from s order by total desc, fused_rank limit 12""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50 + 50, fused to 20, reranked to 12; the reranker here is a declared offline substitute for a cross-encoder."""
    rows, q = chunks(spark, sf_dir).where("chunk_id <> 0"), query_vector(spark, sf_dir)
    from millrace.functions.vectors import cosine_distance_literal

    score = F.coalesce("score", F.lit(0.0)) + 10 * (1 - F.round(cosine_distance_literal(F.col("embedding"), q), 6))
    return retrieval.hybrid(rows, q, hits(spark, sf_dir), score).select("chunk_id", F.col("final_rank").cast("long").alias("final_rank"))


@query("""
    with i as (select unnest([42, 7, 99999999, 13, 300]) as doc_id, unnest([1, 2, 3, 4, 5]) as rank)
    select cast(doc_id as bigint) as doc_id, cast(rank as bigint) as rank, lang, source from i join documents using (doc_id)""")
def details_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details of a ranked id list; an unknown id is left out."""
    ids = spark.createDataFrame([(42, 1), (7, 2), (99999999, 3), (13, 4), (300, 5)], "doc_id long, rank long")
    return retrieval.details(ids, load(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")


@query("select page_id, p.url, d.lang as document_lang, d.source as document_source from pages p left join documents d on d.doc_id = p.page_id * 5")
def chunk_with_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url", (F.col("page_id") * 5).alias("doc_id"))
    out = retrieval.with_document(pages, load(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    return out.select("page_id", "url", F.col("document.lang").alias("document_lang"), F.col("document.source").alias("document_source"))


@query("""
    select doc_id, lang, source, n_chars from documents where source in ('src1', 'src2', 'src3') and lang = 'en' and n_chars >= 500 and n_chars <= 5000""")
def optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the filters that are given reach the scan."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("doc_type"), "source", "n_chars")
    out = retrieval.filtered(rows, ["src1", "src2", "src3"], "en", 500, 5000, group="source", day="n_chars")
    return out.withColumnRenamed("doc_type", "lang")


@query(rf"""
    select doc_id, cast(rank as integer) as rank from (
        select doc_id, len(list_filter({TOKENS_SQL}, lambda t: t in ('thing', 'ing', 'tion'))) as rank, ' ' || array_to_string({BARE_SQL}, ' ') || ' ' as s from documents)
    where (contains(s, ' thing ') and not contains(s, ' idiot ')) or contains(s, ' ing tion ')
    order by rank desc, doc_id limit 60""")
def full_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web-style query: words, a negation, an alternative phrase."""
    return fts.search(load(spark, sf_dir, "documents").select("doc_id", "text"), "text", 'the thing -idiot or "ing of tion"').select("doc_id", "rank")


COVER = 'thing tion -idiot or "ing of tion"'


@query(f"select doc_id, round(cover_rank, 6) as cover_rank from ({fts.cover_sql(fts.parse(COVER, True))})")
def full_text_cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cover-density rank of stemmed tokens, phrases and negations included, from postings."""
    out = fts.ranked_by_cover(load(spark, sf_dir, "documents"), COVER)
    return out.select("doc_id", F.round("cover_rank", 6).alias("cover_rank"))


@query(r"""
    with n as (select doc_id, ' ' || regexp_replace(lower(text), '\s+', ' ', 'g') || ' ' as t from documents),
    b as (select item_id, regexp_replace(lower(text), '\s+', ' ', 'g') as t from benchmark)
    select item_id, cast(count(doc_id) as bigint) as hits, count(doc_id) > 0 as present from b left join n on contains(n.t, b.t) group by 1""")
def grade_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded cases: which passages the corpus holds, regardless of case and spacing."""
    return evaluation.presence(load(spark, sf_dir, "benchmark"), load(spark, sf_dir, "documents"), "item_id", "doc_id")


@query("""
    with g as (select d.source as grp, l.quality, l.toxic from documents d join labels l using (doc_id))
    select grp, cast(count(*) as bigint) as cases, cast(count(*) filter (quality = 1 and toxic = 0) as bigint) as passed, bool_and(quality = 1) as all_passed from g group by 1""")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("grp")).join(load(spark, sf_dir, "labels"), "doc_id")
    passed = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("cases"), F.count_if(passed).alias("passed"), F.bool_and(F.col("quality") == 1).alias("all_passed"))


@query(r"""
    with a as (select doc_id, 'As told in [' || doc_id % 9 || '] and [' || doc_id % 4 || '], see [12].' as answer, cast(doc_id % 6 as integer) as n from documents)
    select doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda x: cast(x as integer)))), ',') as cited,
           array_to_string(list_sort(list_filter(list_distinct(list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda x: cast(x as integer))), lambda c: c < 1 or c > n)), ',') as bad from a""")
def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited numbers of answers, and those outside the evidence."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("As told in ["), (F.col("doc_id") % 9).cast("string"), F.lit("] and ["), (F.col("doc_id") % 4).cast("string"), F.lit("], see [12].")).alias("answer"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return d.select("doc_id", joined(text.citations(F.col("answer"))).alias("cited"), joined(text.bad_citations(F.col("answer"), F.col("doc_id") % 6)).alias("bad"))
