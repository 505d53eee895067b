"""Queries of text quality, classification, cleaning and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import chunking
from millrace.plans.registry import load, query

WORD_LIST = text.ENGLISH + "thing tion ing und der die das que les des con por una est est of reen".split()
QUOTED = "', '".join(sorted(set(WORD_LIST)))
TOKENS = r"list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '')"
EDGES = ".,;:!?\"''()-"
QUALITY_SQL = rf"""
    t as (select doc_id, coalesce(text, '') as text, {TOKENS} as w from documents),
    m as (select *, len(w) as n, length(regexp_replace(text, '[ \t\n]', '', 'g')) as bare, length(regexp_replace(text, '\PL', '', 'g')) as letters from t),
    q as (
        select doc_id, text, w, cast(n as integer) as word_count, case when n > 0 and bare > 0 then 1 - letters / bare else 1 end as non_alpha_ratio,
               case when n > 0 then list_sum(list_transform(w, lambda x: length(x))) / n else 0 end as avg_word_len,
               case when n > 0 then len(list_filter(w, lambda x: trim(lower(x), '{EDGES}') in ('{QUOTED}'))) / n else 0 end as dict_word_ratio from m),
    s as (select *, dict_word_ratio * case when avg_word_len < 2 or avg_word_len > 16 then 0.5 else 1 end * case when non_alpha_ratio > 0.5 then 0.5 else 1 end as quality_score,
                 (avg_word_len < 2 or avg_word_len > 16 or non_alpha_ratio > 0.5) as weak from q),
    v as (select *, case when word_count < 3 or dict_word_ratio < 0.18 or (dict_word_ratio < 0.28 and weak) then 'quarantined' else 'active' end as status,
                 case when word_count < 3 then 'too_short' when dict_word_ratio < 0.18 or (dict_word_ratio < 0.28 and weak) then 'ocr_illegible' when dict_word_ratio < 0.4 then 'reassignment_candidate' end as reason from s)
"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "text", "source")


@query(rf"select doc_id, cast(len({TOKENS}) as integer) as n from documents")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.word_count(F.col("text")).alias("n"))


@query(f"with {QUALITY_SQL} select doc_id, word_count, round(cast(non_alpha_ratio as double), 6) as non_alpha_ratio, round(cast(avg_word_len as double), 6) as avg_word_len, round(cast(dict_word_ratio as double), 6) as dict_word_ratio, round(cast(quality_score as double), 6) as quality_score from v")
def quality_subscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["non_alpha_ratio", "avg_word_len", "dict_word_ratio", "quality_score"]
    return text.with_quality(_docs(spark, sf_dir), word_list=WORD_LIST).select("doc_id", "word_count", *(F.round(n, 6).alias(n) for n in names))


@query(f"with {QUALITY_SQL} select doc_id, case when doc_id % 50 = 0 then 'quarantined' else status end as status, case when doc_id % 50 = 0 then 'cluster_refused' else reason end as reason from v")
def quality_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on a rescore: what a cluster refused stays quarantined."""
    rows = text.with_quality(_docs(spark, sf_dir), word_list=WORD_LIST).withColumn("old", F.when(F.col("doc_id") % 50 == 0, "cluster_refused"))
    return text.with_verdict(rows, "old").select("doc_id", "status", "reason")


@query(f"with {QUALITY_SQL} select status, coalesce(reason, 'clean') as reason, cast(count(*) as bigint) as n, round(cast(avg(quality_score) as double), 6) as mean from v group by 1, 2")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counters of a scoring pass."""
    rows = text.with_verdict(text.with_quality(_docs(spark, sf_dir), word_list=WORD_LIST))
    return rows.groupBy("status", F.coalesce("reason", F.lit("clean")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality_score"), 6).alias("mean"))


#: Lines of ours after the document's text, so that every class occurs.
LINES = ["", " FOR SALE at auction, $5 reward", " NOTICE IS HEREBY GIVEN by the SUPREME COURT in CHANCERY", " 12 34 56 78 90 11 22 33", " roll call: members present", " motion by A, seconded by B. Minutes of the last regular meeting", " call to order; adjourned", " $1,200.50 3.26% (54,430) 9,200 1621.402"]
LINES_SQL = "['" + "', '".join(LINES) + "']"


def _lined(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.element_at(F.lit(LINES), (F.col("doc_id") % len(LINES) + 1).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", F.concat("text", line).alias("text"))


LINED_SQL = f"l as (select doc_id, text || {LINES_SQL}[doc_id % {len(LINES)} + 1] as text from documents)"
SQL_LEGAL, SQL_PRICE, SQL_AD = text.LEGAL, text.PRICE, text.AD_KEYWORDS


@query(rf"""
    with {LINED_SQL}, t as (select doc_id, text, {TOKENS} as w from l),
    m as (select *, len(w) as n, length(replace(text, ' ', '')) as bare, length(regexp_replace(text, '\PL', '', 'g')) as letters, list_sum(list_transform(w, lambda x: length(x))) / nullif(len(w), 0) as mean,
                 len(list_filter(w, lambda x: trim(lower(x), '{EDGES}') in ('{QUOTED}'))) / nullif(len(w), 0) as known from t)
    select doc_id, cast(case when n = 0 or (n >= 5 and (letters / bare < 0.6 or mean < 2 or mean > 15 or known < 0.3)) then 3
        when len(regexp_extract_all(text, '{SQL_LEGAL}')) >= 2 then 2
        when (n < 80 and regexp_matches(text, '{SQL_PRICE}')) or regexp_matches(text, '{SQL_AD}') then 1 else 0 end as integer) as class from m""")
def content_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.with_content_class(_lined(spark, sf_dir), word_list=WORD_LIST).select("doc_id", "class")


TOKEN_EDGES = text.TOKEN_EDGES.replace("'", "''")
FAMILY_SQL = " + ".join(f"cast(regexp_matches(text, '{p}') as integer)" for p in text.FAMILIES.values())


@query(rf"""
    with {LINED_SQL}, t as (select doc_id, text, {TOKENS} as w from l),
    m as (select *, len(w) as n, {FAMILY_SQL} as families,
                 case when len(w) >= 5 then len(list_filter(w, lambda x: regexp_matches(x, '^[($]?-?[\d,]+(?:\.\d+)*\)?%?$') or (length(trim(lower(x), '{TOKEN_EDGES}')) >= 2 and trim(lower(x), '{TOKEN_EDGES}') in ('{QUOTED}')))) / len(w) end as share from t),
    r as (select *, case when share < 0.25 then 'garbled' when n < 8 and not regexp_matches(text, '\$\s?\d') then 'too_short' when n <= 180 and families >= 2 then 'procedural' end as reason from m)
    select doc_id, case when reason is null then 'active' else 'quarantined' end as status, reason, cast(families as integer) as families,
           case when reason = 'garbled' then round(cast(share as double), 3) when reason is not null then 0.2
                else round(cast(least(1.0, coalesce(share, 0.6)) * case when families = 1 and n <= 180 then 0.85 else 1 end as double), 3) end as quality_score from r""")
def chunk_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled, too short, procedural or active, with the share of known words."""
    return text.with_chunk_verdict(_lined(spark, sf_dir), word_list=WORD_LIST).select("doc_id", "status", "reason", "families", "quality_score")


@query(r"""
    select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(coalesce(text, '')), '[\x00-\x08\x0b-\x1f]', '', 'g'), '[ \t\f\x0b]+', ' ', 'g'), '\n\s*\n\s*(\n\s*)+', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13)) as clean from documents""")
def clean_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.clean_ocr(F.col("text")).alias("clean"))


@query(r"""
    with s as (select page_id, url, case when trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '-._') = '' then 'untitled' else trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '-._')[1:120] end as slug from pages)
    select page_id, slug, regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) as name, regexp_extract(lower(regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1)), '(\.[a-z0-9]{1,8})$', 1) as ext, sha256(url) as digest from s""")
def slugs_and_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, u = load(spark, sf_dir, "pages"), F.col("url")
    return p.select("page_id", text.slug(u).alias("slug"), text.file_name(u).alias("name"), text.extension(text.file_name(u)).alias("ext"), F.sha2(u, 256).alias("digest"))


ANSWERS = ["The sources do not address this.", "The sources do not address this, but see [2].", "Yes [1].", "I cannot read it", "Unclear text", "OCR-damaged notices", "School budget votes", "No clear theme"]


@query("""
    select doc_id, [true, false, false, false, false, false, false, false][doc_id % 8 + 1] as refusal, [false, false, false, true, true, true, false, true][doc_id % 8 + 1] as label_refusal from documents""")
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.element_at(F.lit(ANSWERS), (F.col("doc_id") % len(ANSWERS) + 1).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", text.is_refusal(answer, "do not address").alias("refusal"), text.is_label_refusal(answer).alias("label_refusal"))


@query("""
    select conv_id, turn, 'conv ' || conv_id || ' · ' || case when turn % 2 = 0 then '2024-01-0' || (turn + 1) else 'undated' end || ' · ' || role || case when turn > 0 then ' › turn ' || turn else '' end as prefix from conversations""")
def embedding_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    day = F.when(t % 2 == 0, F.date_add(F.lit("2024-01-01").cast("date"), t.cast("int")))
    heading = F.when(t > 0, F.concat(F.lit("turn "), t.cast("string")))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", text.embedding_prefix(F.concat(F.lit("conv "), F.col("conv_id").cast("string")), day, F.col("role"), heading).alias("prefix"))


@query(r"""
    with b as (select item_id, regexp_replace(lower(text), '\s+', ' ', 'g') as t from benchmark)
    select item_id, contains(t, 'the') and contains(t, 'ing') as all_present from b""")
def must_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether texts hold every wanted string."""
    from millrace.operators.evaluation import all_present

    return load(spark, sf_dir, "benchmark").select("item_id", all_present(F.col("text"), F.lit(["THE", "ing"])).alias("all_present"))


@query()
def window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word windows that end at sentences; tests hold the spans against worked cases."""
    out = chunking.window_chunks(_docs(spark, sf_dir))
    return out.select("doc_id", "chunk_index", "word_start", "word_end", F.md5("content").alias("content_md5"))


def _agendas(conversations: DataFrame) -> DataFrame:
    """Conversations as agendas: each turn a numbered part, all its sentences lettered items; after Z comes A again. Null turns come last, null texts are empty."""
    turns = F.array_sort(F.collect_list(F.struct(F.col("turn").isNull().alias("last"), "turn", F.coalesce("text", F.lit("")).alias("text"))))

    def part(t, i):
        lines = F.transform(F.split(t["text"], r"(?<=\.)\s"), lambda s, j: F.concat(F.char(j % 26 + 65), F.lit(". "), s))
        kind = F.when(t["turn"] % 2 == 1, "Consent Agenda").otherwise("Reports")
        return F.concat((i + 1).cast("string"), F.lit(". "), kind, F.lit("\n"), F.array_join(lines, "\n"))

    return conversations.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.array_join(F.transform("turns", part), "\n\n").alias("text"))


@query()
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline sections of agendas; tests hold them against worked cases."""
    return chunking.section_chunks(_agendas(load(spark, sf_dir, "conversations"))).select("conv_id", "chunk_index", "section_path", "section_type", F.md5("content").alias("content_md5"))


@query("""
    with t as (select doc_id, '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || doc_id || ' | x |' as grid from documents)
    select doc_id, cast(5 + i as integer) as chunk_index, 'T' || case i when 2 then 4 else 2 end || '#' || case i when 1 then 2 else 1 end as section_path, grid as content, 'table' as kind
    from t cross join (select unnest([0, 1, 2]) as i)""")
def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tables as chunks; their index goes on after the prose."""
    grid = F.concat(F.lit("| a | b |\n|---|---|\n| "), F.col("doc_id").cast("string"), F.lit(" | x |"))
    tables = F.array(*(F.struct(F.lit(p).alias("page"), grid.alias("markdown")) for p in (2, 2, 4)))
    return chunking.table_chunks(_docs(spark, sf_dir).select("doc_id", tables.alias("tables")), after=F.lit(5))


@query("""
    select doc_id, cast(1 as integer) as first_line, cast(2 as integer) as n_lines, '| a | b |' || chr(10) || '| c | d |' as markdown, 'x' || chr(10) || '| one row |' || chr(10) || 'y ' || doc_id as prose from documents""")
def pipe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or more pipe rows are tables, a single one stays prose."""
    page = F.concat(F.lit("x\n| a | b |\n| c | d |\n\n| one row |\ny "), F.col("doc_id").cast("string"))
    rows = _docs(spark, sf_dir).select("doc_id", page.alias("page"))
    prose = rows.select("doc_id", F.replace(chunking.prose_without_tables(F.col("page")), F.lit("\n\n"), F.lit("\n")).alias("prose"))
    return chunking.pipe_tables(rows, "doc_id", "page").join(prose, "doc_id")


@query(r"""
    with d as (select o_orderkey, o_orderdate, case when o_orderkey % 2 = 0 then 'Board Meeting ' || strftime(o_orderdate, '%B %-d, %Y') else 'Untitled' end as title from orders)
    select o_orderkey, case when o_orderkey % 2 = 0 then cast(o_orderdate as date) when o_orderkey % 3 = 0 then date '2011-03-04' else date '2001-01-01' end as meeting_date, case when o_orderkey % 2 = 0 then 'agenda' else 'other' end as doc_type from d""")
def prepared_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date of title, else of the text's beginning, else of the manifest; type by title where it was other."""
    k = F.col("o_orderkey")
    rows = load(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 2 == 0, F.concat(F.lit("Board Meeting "), F.date_format("o_orderdate", "MMMM d, yyyy"))).otherwise("Untitled").alias("title"),
        F.when(k % 3 == 0, "held March 4, 2011 here").otherwise("none").alias("text"), F.lit("other").alias("doc_type"), F.lit("2001-01-01").cast("date").alias("date"),
    )
    return chunking.prepared(rows).select("o_orderkey", "meeting_date", "doc_type")


@query("select doc_id, source from documents where length(coalesce(text, '')) >= case doc_id % 3 when 0 then 200 when 1 then 1 else 40 end")
def large_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("pdf"), F.lit("html"), F.lit("prose")), (F.col("doc_id") % 3 + 1).cast("int"))
    return chunking.large_enough(_docs(spark, sf_dir), kind).select("doc_id", "source")
