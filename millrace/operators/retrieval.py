"""Retrieval: ranked legs per group or over all, rank fusion, caps per document, absence as a result.

Filters stand before the windows; ranks break ties by id. A per-group top n becomes a partial and a final group limit,
so only n rows of a group leave a task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.vectors import cosine_distance_literal

RRF_K, LEG, POOL, PER_DOCUMENT, PER_GROUP = 60, 50, 20, 2, 4


def filtered(chunks: DataFrame, groups: Sequence[str] | None = None, doc_type: str | None = None, date_from: date | None = None, date_to: date | None = None, group: str = "district", day: str = "meeting_date") -> DataFrame:
    """Only the filters that are given; both ends of the dates count."""
    given = []
    if groups is not None:
        given.append(F.col(group).isin(list(groups)))
    if doc_type is not None:
        given.append(F.col("doc_type") == doc_type)
    if date_from is not None:
        given.append(F.col(day) >= F.lit(date_from))
    if date_to is not None:
        given.append(F.col(day) <= F.lit(date_to))
    return chunks.where(reduce(lambda a, b: a & b, given, F.lit(True)))


def active(chunks: DataFrame) -> DataFrame:
    return chunks.where("status = 'active'")


def ranked(df: DataFrame, order: Sequence[Column], group: str | None = None, most: int | None = None, out: str = "rank") -> DataFrame:
    """df with its rank from 1, in each group or over all, the first `most` only."""
    if group is None:  # a global rank follows a limit: sorted runs merge, and only the first rows are numbered
        first = df.orderBy(*order).limit(most) if most is not None else df
        return first.withColumn(out, F.row_number().over(Window.orderBy(*order)))
    numbered = df.withColumn(out, F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return numbered if most is None else numbered.where(F.col(out) <= most)


def semantic_leg(chunks: DataFrame, vector: Sequence[float], most: int, group: str | None = None, id_col: str = "chunk_id", embedding: str = "embedding") -> DataFrame:
    """Nearest chunks by cosine distance; rows without embedding take no part."""
    scored = chunks.where(F.col(embedding).isNotNull()).withColumn("distance", cosine_distance_literal(F.col(embedding), vector)).drop(embedding)
    return ranked(scored, [F.col("distance"), F.col(id_col)], group, most)


def scored_leg(chunks: DataFrame, score: Column, most: int, group: str | None = None, id_col: str = "chunk_id") -> DataFrame:
    """Best chunks by a score, of those that have one above zero."""
    hits = chunks.withColumn("score", score).where("score > 0")
    return ranked(hits, [F.col("score").desc(), F.col(id_col)], group, most)


def lexical_leg(chunks: DataFrame, hits: DataFrame, most: int, group: str | None = None, id_col: str = "chunk_id") -> DataFrame:
    """Best chunks by full-text rank. hits: (id, score) of the chunks that match; only ids and groups of chunks are read."""
    keys = [c for c in (group, id_col) if c]
    return ranked(chunks.select(*keys).join(hits.where("score > 0"), id_col), [F.col("score").desc(), F.col(id_col)], group, most)


def fuse(legs: Sequence[DataFrame], most: int | None = None, group: str | None = None, id_col: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank) over the legs that hold an id."""
    keys = [c for c in (group, id_col) if c]
    rows = reduce(DataFrame.unionByName, (leg.select(*keys, "rank") for leg in legs))
    fused = rows.groupBy(*keys).agg(F.sum(1 / (k + F.col("rank"))).alias("rrf"))
    return ranked(fused, [F.round("rrf", 12).desc(), F.col(id_col)], group, most, "fused_rank")


def capped(df: DataFrame, document: str, rank: str, most: int = PER_GROUP, per_document: int = PER_DOCUMENT, group: str = "district") -> DataFrame:
    """At most `per_document` rows of a document, in rank order; if too few are left, the rest fill up in rank order."""
    df = df.withColumn("overflow", F.row_number().over(Window.partitionBy(group, document).orderBy(rank)) > per_document)
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("overflow", rank))).where(F.col("place") <= most)


def absent(groups: DataFrame, found: DataFrame, group: str = "district") -> DataFrame:
    """Groups without a row: absence is a result of its own."""
    return groups.select(group).distinct().join(found.select(group).distinct(), group, "left_anti")


def panel(chunks: DataFrame, groups: DataFrame, vector: Sequence[float], hits: DataFrame, rerank: Callable[[DataFrame], DataFrame] | None = None, leg: int = LEG, pool: int = 12, most: int = PER_GROUP, group: str = "district", id_col: str = "chunk_id", document: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """Evidence of each group, and the groups without any. hits: as `lexical_leg` takes them. rerank: adds `rerank_score`; without it the fused rank decides."""
    legs = [semantic_leg(chunks, vector, leg, group, id_col), lexical_leg(chunks, hits, leg, group, id_col)]
    fused = fuse(legs, pool, group, id_col)
    rows = fused.join(chunks.drop("embedding"), [group, id_col])
    if rerank:
        rows = ranked(rerank(rows), [F.coalesce("rerank_score", F.lit(0.0)).desc(), F.col("fused_rank")], group, None, "final_rank")
    else:
        rows = rows.withColumn("final_rank", F.col("fused_rank"))
    evidence = capped(rows, document, "final_rank", most, group=group)
    return evidence, absent(groups, evidence, group)


def hybrid(chunks: DataFrame, vector: Sequence[float], hits: DataFrame, rerank: Column, leg: int = LEG, pool: int = POOL, most: int = 12, id_col: str = "chunk_id") -> DataFrame:
    """Both legs over all, fused to a pool, reranked by a score, which may use `score` of the hits. hits: as `lexical_leg` takes them."""
    fused = F.broadcast(fuse([semantic_leg(chunks, vector, leg, None, id_col), lexical_leg(chunks, hits, leg, None, id_col)], pool, None, id_col))  # pool rows at most
    rows = chunks.join(fused, id_col).join(F.broadcast(hits.join(fused.select(id_col), id_col)), id_col, "left")
    return ranked(rows.withColumn("rerank_score", F.coalesce(rerank, F.lit(0.0))), [F.col("rerank_score").desc(), F.col("fused_rank")], None, most, "final_rank")


def details(ids: DataFrame, chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Rows of a ranked id list in its order; unknown ids are left out."""
    return ids.select(id_col, "rank").join(chunks, id_col).orderBy("rank")


def with_document(chunks: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Each chunk with its document as a struct, null if there is none."""
    nested = documents.select(key, F.struct(*(c for c in documents.columns if c != key)).alias("document"))
    return chunks.join(nested, key, "left")


def evidence_text(rows: DataFrame, group: str = "district", rank: str = "place", content: str = "content", most: int = 1800) -> DataFrame:
    """rows numbered across groups in order of group and rank, with `block`: "[n] group" and the text, cut at `most` characters.

    For the few rows of a panel: the number needs them in one task."""
    n = F.row_number().over(Window.orderBy(group, rank))
    cut = F.when(F.char_length(content) > most, F.concat(F.substring(content, 1, most), F.lit(" …"))).otherwise(F.col(content))
    return rows.withColumn("n", n).withColumn("block", F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.col(group), F.lit("\n"), cut))


def mmr(rows: list[tuple[object, float, Sequence[float]]], most: int, balance: float = 0.5) -> list[object]:
    """Maximal marginal relevance over a pool of (id, relevance, vector): for the few rows of a fused pool."""
    unit = lambda v: [x / (sum(y * y for y in v) ** 0.5 or 1.0) for x in v]
    left, picked = [(i, r, unit(v)) for i, r, v in rows], []
    while left and len(picked) < most:
        nearness = lambda v: max((sum(a * b for a, b in zip(v, w, strict=True)) for _, _, w in picked), default=0.0)
        best = max(left, key=lambda x: (balance * x[1] - (1 - balance) * nearness(x[2]), -left.index(x)))
        left.remove(best)
        picked.append(best)
    return [i for i, _, _ in picked]
