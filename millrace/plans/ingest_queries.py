"""Queries of paged files, portals, extraction candidates and what ingestion writes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.taxonomy import doc_type_of_title
from millrace.operators import chunking, clusters, incremental, series, threads
from millrace.plans.registry import load, query
from millrace.sources import layout, portals

STOPS = "', '".join(series.STOPWORDS)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as paged files: a turn a page."""
    return load(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("page"), "text")


def _box(*sides) -> F.Column:
    return F.struct(*(s.cast("double").alias(n) for s, n in zip(sides, ("x0", "y0", "x1", "y1"), strict=True)))


@query("""
    select conv_id, trim(string_agg(coalesce(text, ''), chr(10) order by turn), ' ' || chr(9) || chr(10) || chr(13)) as text, count(*) as page_count from conversations group by 1""")
def paged_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages joined in order."""
    return layout.page_text(_turns(spark, sf_dir), "conv_id")


@query("""
    with p as (select conv_id, turn as page, length(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13))) as n, greatest(turn % 4, 0) * 100.0 * 100 as whole from conversations),
    i as (select conv_id, turn as page, 100.0 * (20 + 10 * (conv_id % 5)) as image from conversations where turn % 3 <> 1)
    select conv_id, page from p join i using (conv_id, page) where n <= 120 and whole > 0 and image / whole >= 0.45""")
def scanned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with hardly any text and an image over much of them."""
    turns, zero = _turns(spark, sf_dir), F.lit(0)
    pages = turns.select("conv_id", "page", "text", _box(zero, zero, F.col("page") % 4 * 100, F.lit(100)).alias("box"))
    large = turns.where("page % 3 <> 1").select("conv_id", "page", _box(zero, zero, F.lit(100), 20 + 10 * (F.col("conv_id") % 5)).alias("box"))
    return layout.image_only_pages(pages, large.unionByName(large.withColumn("box", _box(zero, zero, F.lit(5), F.lit(5)))), "conv_id")


@query("""
    with c as (select *, (conv_id + turn) % 7 as k from conversations),
    kept as (select conv_id, turn, text from c where not (k in (2, 3) or (k = 4 and turn % 2 = 0)))
    select conv_id, trim(coalesce((select string_agg(coalesce(text, ''), chr(10) order by turn) from kept where kept.conv_id = d.conv_id), ''), ' ' || chr(9) || chr(10) || chr(13)) as text
    from (select distinct conv_id from conversations) d""")
def prose_outside_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that lie by half or more in a grid of their page leave the prose; grids of one row are none."""
    turns = _turns(spark, sf_dir)
    k = (F.col("conv_id") + F.col("page")) % 7
    blocks = turns.select("conv_id", "page", F.lit(0).alias("block"), _box(F.lit(0), F.lit(0), F.lit(100), F.lit(10)).alias("box"), "text")
    width = F.when(k == 2, 100).when(k == 3, 50).when(k == 4, F.when(F.col("page") % 2 == 0, 80).otherwise(40)).otherwise(100)
    tables = turns.where((k >= 2) & (k <= 5)).select("conv_id", "page", _box(F.lit(0), F.lit(0), width, F.lit(10)).alias("box"), F.when(k == 5, 1).otherwise(3).alias("n_rows"), F.lit(2).alias("n_columns"))
    return layout.prose_outside_grids(blocks, tables, "conv_id")


@query("""
    select d.doc_id, trim(case when coalesce(d.text, '') = '' then coalesce(b.text, '') when coalesce(b.text, '') = '' then d.text else d.text || chr(10) || chr(10) || b.text end, ' ' || chr(9) || chr(10) || chr(13)) as text,
           array_to_string(list_concat(['t' || d.doc_id], case when b.item_id is null then [] else ['ocr ' || b.item_id] end), ',') as tables, cast(case when d.doc_id % 3 > 0 then d.doc_id % 3 when b.item_id is not null then 9 end as bigint) as page_count
    from documents d left join benchmark b on b.item_id = d.doc_id""")
def merged_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was read first leads, pages that were read later follow with their tables."""
    base = load(spark, sf_dir, "documents").select("doc_id", "text", F.array(F.concat(F.lit("t"), F.col("doc_id").cast("string"))).alias("tables"), (F.col("doc_id") % 3).alias("page_count"))
    later = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.array(F.concat(F.lit("ocr "), F.col("item_id").cast("string"))).alias("tables"), F.lit(9).cast("long").alias("page_count"))
    return layout.merged(base, later, "doc_id").withColumn("tables", F.array_join("tables", ","))


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a portal lists meetings, a body a customer, newest first; every eleventh has no date."""
    o = load(spark, sf_dir, "orders")
    number = F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    entry = F.struct((-F.unix_date(F.to_date("o_orderdate"))).alias("newest"), F.col("o_orderkey").alias("key"), F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("unique"), F.col("o_orderstatus").alias("name"), number.alias("numberdate"))
    listed = F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["unique"].alias("unique"), e["name"].alias("name"), e["numberdate"].alias("numberdate")))
    return o.groupBy("o_custkey").agg(F.to_json(listed).alias("body"))


@query("""
    with m as (select o_custkey, 'm' || o_orderkey as "unique", case when o_orderkey % 11 <> 0 then cast(o_orderdate as date) end as day, row_number() over (partition by o_custkey order by cast(o_orderdate as date) desc, o_orderkey) - 1 as place from orders),
    k as (select *, row_number() over (partition by o_custkey order by place) as n from m where day is null or day >= date '1996-01-01')
    select o_custkey, cast(place as integer) as place, "unique", day from k where n <= 3""")
def portal_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first meetings since a day; undated ones stay."""
    return portals.meetings(_bodies(spark, sf_dir), ["o_custkey"], since=date(1996, 1, 1), most=3).select("o_custkey", "place", "unique", "day")


@query("""select o_custkey, 'm' || o_orderkey as "unique", o_orderstatus as name from orders""")
def portal_committees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a portal's list."""
    return portals.committees(_bodies(spark, sf_dir)).select("o_custkey", "unique", "name")


@query(r"select page_id, unnest(list_distinct(regexp_extract_all(coalesce(html, ''), 'https?://[A-Za-z0-9.-]+/[A-Za-z0-9/_.-]*'))) as address from pages")
def portal_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in pages, each once a page."""
    return portals.harvested(load(spark, sf_dir, "pages").select("page_id", "html"), "html", r"https?://[A-Za-z0-9.-]+/[A-Za-z0-9/_.-]*")


CELLS = ["| MA+30 | 90,000 |", "| ba 15 | 1 |", "| BAMA15 |", "| step 3 |", "| misstep | footstep |", "| Ph. D |", "| Longevity |", "| Extra-duty |", "| x |"]
CELLS_SQL = "['" + "', '".join(CELLS) + "']"
CANDIDATE_SQL = f"(?i){incremental.CANDIDATE}"


def _chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Line items as chunks of orders, with table rows as content."""
    li, o = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    pick = F.element_at(F.lit(CELLS), ((F.col("l_partkey") % len(CELLS)) + 1).cast("int"))
    chunks = li.select(
        F.col("l_orderkey").alias("document"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk"), F.when(F.col("l_returnflag") == "R", "table").otherwise("prose").alias("kind"),
        F.when(F.col("l_linestatus") == "O", "active").when(F.col("l_linenumber") < 4, "active").otherwise("quarantined").alias("status"), pick.alias("content"), F.lit(None).cast("string").alias("heading"),
        F.when(F.col("l_suppkey") % 4 == 0, 1).alias("extracted_at"), F.lit("other").alias("doc_type"),
    )
    titles = ["Coach pay", "Agenda 1", "Board_Minutes", "Photo", "Budget"]
    documents = o.select(
        F.col("o_orderkey").alias("document"), F.concat(F.lit("s"), (F.col("o_custkey") % 9).cast("string")).alias("slug"), F.element_at(F.lit(titles), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("title"),
        F.when(F.col("o_orderkey") % 7 != 0, F.to_date("o_orderdate")).alias("day"), F.when(F.col("o_orderkey") % 2 == 0, "other").otherwise("policy").alias("doc_type"),
    )
    return chunks, documents


CHUNK_DOCUMENT_SQL = f"""
    c as (select l_orderkey as document, l_orderkey * 10 + l_linenumber as chunk, l_returnflag = 'R' and (l_linestatus = 'O' or l_linenumber < 4) as is_table, {CELLS_SQL}[l_partkey % {len(CELLS)} + 1] as content, l_suppkey % 4 = 0 as done from lineitem),
    d as (select o_orderkey as document, 's' || o_custkey % 9 as slug, ['Coach pay', 'Agenda 1', 'Board_Minutes', 'Photo', 'Budget'][o_orderkey % 5 + 1] as title, case when o_orderkey % 7 <> 0 then cast(o_orderdate as date) end as day from orders)
"""


@query(f"with {CHUNK_DOCUMENT_SQL} select chunk, slug, day from c join d using (document) where is_table and not done and (regexp_matches(content, '{CANDIDATE_SQL}') or regexp_matches(title, '{CANDIDATE_SQL}'))")
def extraction_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that a keyword names and that weren't extracted yet."""
    chunks, documents = _chunks(spark, sf_dir)
    return incremental.extraction_candidates(chunks.drop("doc_type"), documents.drop("doc_type"), "document", "chunk").select("chunk", "slug", "day")


@query("""
    with d as (select o_orderkey, case when o_orderkey % 2 = 0 then ['other', 'agenda', 'minutes', 'other', 'budget'][o_orderkey % 5 + 1] else 'policy' end as doc_type from orders)
    select l_orderkey * 10 + l_linenumber as chunk, doc_type from lineitem join d on o_orderkey = l_orderkey""")
def reclassified_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of type other get one by their title, and their chunks with them."""
    chunks, documents = _chunks(spark, sf_dir)
    return incremental.reclassified(documents, chunks, "document", doc_type_of_title(F.col("title")))[1].select("chunk", "doc_type")


@query("""
    select o_orderkey, case when o_orderkey % 3 = 0 then case when o_orderkey % 2 = 0 then 'ingested' else 'error' end when o_orderkey % 3 = 1 then o_orderstatus else o_orderstatus end as status,
           case when o_orderkey % 3 = 0 and o_orderkey % 2 = 1 then 'broken' end as error, case when o_orderkey % 3 = 0 and o_orderkey % 2 = 0 then date '2024-05-06' else cast(o_orderdate as date) end as ingested_at from orders""")
def marked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null in an update leaves the status; the day of ingestion is set with the status only."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("error"), F.to_date("o_orderdate").alias("ingested_at"))
    k = F.col("o_orderkey")
    updates = o.where(k % 3 < 2).select("o_orderkey", F.when(k % 3 == 0, F.when(k % 2 == 0, "ingested").otherwise("error")).alias("status"), F.when((k % 3 == 0) & (k % 2 == 1), "broken").alias("error"))
    return incremental.marked(o, updates, "o_orderkey", F.lit("2024-05-06").cast("date"))


@query("""
    select p_partkey, case when p_size > 25 then 'new ' || p_name else p_name end as p_name, case when p_size > 25 then date '2024-05-06' else date '2020-01-01' end as updated_at from part""")
def touched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are written carry the time of the write."""
    p = load(spark, sf_dir, "part")
    stored = p.select("p_partkey", "p_name", F.lit("2020-01-01").cast("date").alias("updated_at"))
    written = p.where("p_size > 25").select("p_partkey", F.concat(F.lit("new "), F.col("p_name")).alias("p_name"), F.lit("1999-01-01").cast("date").alias("updated_at"))
    return incremental.touched(stored, written, ["p_partkey"], F.lit("2024-05-06").cast("date"))


@query("""
    with c as (select l_orderkey as document, l_partkey % 5 + 1 || '.' || chr(cast(65 + l_linenumber % 3 as integer)) || case when l_suppkey % 2 = 0 then '.' || l_suppkey % 4 else '' end as path from lineitem),
    p as (select document, unnest(list_transform(range(1, len(string_split(path, '.')) + 1), lambda n: list_slice(string_split(path, '.'), 1, n))) as way from c)
    select distinct document, array_to_string(way, '.') as path, case when len(way) > 1 then array_to_string(list_slice(way, 1, len(way) - 1), '.') end as parent, cast(len(way) as integer) as level from p""")
def section_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with their parents from the paths of chunks."""
    li = load(spark, sf_dir, "lineitem")
    path = F.concat((F.col("l_partkey") % 5 + 1).cast("string"), F.lit("."), F.char(65 + F.col("l_linenumber") % 3), F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("."), (F.col("l_suppkey") % 4).cast("string"))).otherwise(""))
    return chunking.section_tree(li.select(F.col("l_orderkey").alias("document"), path.alias("section_path")), "document")


@query("""
    select chunk, day from (select conv_id * 1000 + turn as chunk, case when turn % 4 <> 3 then date '2024-01-01' + cast(conv_id % 300 as integer) end as day, role from conversations) where role = 'assistant' and chunk not in (select conv_id * 1000 from conversations where conv_id % 2 = 0) and chunk % 5 <> 0""")
def beat_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose events aren't drawn yet, in the order of time."""
    c = load(spark, sf_dir, "conversations")
    rows = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk"), F.when(F.col("turn") % 4 != 3, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 300).cast("int"))).alias("day"), F.col("role").alias("doc_type"))
    done = rows.where("chunk % 5 = 0").select("chunk").unionByName(c.where("conv_id % 2 = 0").select((F.col("conv_id") * 1000).alias("chunk")))
    return threads.beat_candidates(rows, ["assistant"], "chunk", done=done).select("chunk", "day")


@query(f"""
    with t as (select source, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{3,}}'), lambda x: x not in ('{STOPS}'))) as term from documents),
    c as (select source, term, count(*) as n from t group by 1, 2), f as (select term, sum(n) as f from c group by 1), a as (select sum(n) as t from c),
    s as (select source, term, round(n * ln(t / f), 6) as score from c join f using (term), a where n >= 2),
    r as (select *, row_number() over (partition by source order by score desc, term) as place from s)
    select source, string_agg(term, ', ' order by place)[1:120] as label from r where place <= 3 group by 1""")
def term_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of clusters from their most distinctive words."""
    return clusters.term_labels(load(spark, sf_dir, "documents").select("source", "text"), "source")
