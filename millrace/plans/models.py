"""The engine's model over the given tables: which table stands for which entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import fts
from millrace.plans.registry import load

#: SQL of the same views, for the queries' SQL to build on.
SCHEDULE_SQL = """
    select l_suppkey as grp, 'teacher' as unit, cast(year(o_orderdate) - case when month(o_orderdate) >= 7 then 0 else 1 end as varchar) || '-' ||
           lpad(cast((year(o_orderdate) - case when month(o_orderdate) >= 7 then 0 else 1 end + 1) % 100 as varchar), 2, '0') as school_year,
           case l_returnflag when 'R' then 'MA' when 'A' then 'BA' else 'BA+30' end as lane, l_linenumber as step, l_extendedprice as salary, l_orderkey as source
    from lineitem join orders on l_orderkey = o_orderkey
"""
MEMBERS_SQL = """
    select event_id as id, cast(user_id % 8 as integer) as cluster, cast(ts as date) as day, event_type as paper,
           case when value > 5 then value end as quality, value as x, cast(user_id % 100 as double) as y from events
"""


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Salary cells: supplier as group, order date as school year, return flag as lane, line number as step."""
    from millrace.functions.scalars import school_year

    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_linenumber", "l_extendedprice")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lane = F.when(F.col("l_returnflag") == "R", "MA").when(F.col("l_returnflag") == "A", "BA").otherwise("BA+30")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("l_suppkey").alias("grp"), F.lit("teacher").alias("unit"), school_year(F.col("o_orderdate")).alias("school_year"), lane.alias("lane"),
        F.col("l_linenumber").alias("step"), F.col("l_extendedprice").alias("salary"), F.col("l_orderkey").alias("source"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster members over time: events, their user's bucket as cluster, the type as paper."""
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.pmod("user_id", F.lit(8)).cast("int").alias("cluster"), F.to_date("ts").alias("day"), F.col("event_type").alias("paper"),
        F.when(F.col("value") > 5, F.col("value")).alias("quality"), F.col("value").alias("x"), F.pmod("user_id", F.lit(100)).cast("double").alias("y"),
    )


#: What the lexical legs ask, in the syntax of web searches.
QUESTION = "thing or tion -idiot"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with vectors: embeddings, their label as district, thirty of them a document."""
    e = load(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("district"), F.floor(F.col("vec_id") / 30).alias("document_id"), "embedding")


def hits(spark: SparkSession, sf_dir: str, question: str = QUESTION) -> DataFrame:
    """(chunk_id, score): cover-density rank of the question in the text of the same id, for those that match."""
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return fts.ranked_by_cover(d, question, id_col="chunk_id").select("chunk_id", F.round("cover_rank", 9).alias("score"))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, content): the text of the same id."""
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """A stored vector as the question's: one row."""
    return load(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


FTS_STOP = "', '".join(fts.STOP)
TOKENS_SQL = r"regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN]+')"
BARE_SQL = f"list_filter({TOKENS_SQL}, lambda t: t not in ('{FTS_STOP}'))"
HITS_SQL = f"select doc_id, round(cover_rank, 9) as score from ({fts.cover_sql(fts.parse(QUESTION, True))})"
CHUNKS_SQL = f"""
    select vec_id as chunk_id, label as district, cast(floor(vec_id / 30.0) as bigint) as document_id, score, embedding::double[] as v, (select embedding::double[] from embeddings where vec_id = 0) as q
    from embeddings left join ({HITS_SQL}) on doc_id = vec_id
"""
DISTANCE_SQL = "1 - greatest(-1, least(1, list_cosine_similarity(v, q)))"
