"""Exact duplicates by two-pass Bloom filtering.

Pass one counts every row's hash in a two-plane Bloom filter. Pass two shuffles only rows whose hash is possibly
repeated; all others pass straight through. Texts are equal when identical after each run of ASCII white space becomes
one space, compared by SHA-256.

Defined cases: a null text counts as empty, so null and empty texts are one group. A null doc_id is larger
than any other. Rows that repeat both doc_id and text count as members; `deduplicate` returns one of them, `classes` a row for
each. Extra columns pass through `deduplicate` unchanged, whatever their names. An empty table gives an empty result.
Very long texts are hashed whole; only their hashes shuffle in `classes`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bloom
from millrace.llm.common import ROW, SPACE_RUN, enclosed, lookup, materialize, released, table

SHA, MAYBE = "sha", "maybe_repeated"


def text_sha256(text: Column) -> Column:
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " "), 256)


def _maybe(filt: bloom.Filter, spark: SparkSession):
    shared = spark.sparkContext.broadcast(filt)  # bounded by bloom.MAX_CELLS

    @F.pandas_udf("boolean")
    def maybe(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for k in keys:
            yield pd.Series(shared.value.maybe(k.to_numpy()))

    return maybe


def _split(docs: DataFrame, id_col: str, text_col: str):
    """(doc id, hash, possibly repeated) of every row, the classes of the possibly repeated ones, the number of rows, and the filter as a function of a hash column."""
    spark = docs.sparkSession
    hashed = materialize(docs.select(F.col(id_col).alias("doc_id"), text_sha256(F.col(text_col)).alias(SHA)), "sha256")
    n = hashed.count()
    maybe = _maybe(bloom.repeated_filter(hashed.select(F.xxhash64(SHA)), n), spark)
    flagged = hashed.withColumn(MAYBE, maybe(F.xxhash64(SHA)))
    groups = flagged.where(MAYBE).groupBy(SHA).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("members"))
    return flagged, materialize(groups, "classes"), n, maybe


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    flagged, groups, n, _ = _split(docs, id_col, text_col)
    alone = flagged.where(~F.col(MAYBE)).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("members"), SHA)
    met = lookup(flagged.where(MAYBE).select("doc_id", SHA), SHA, groups, n).select("doc_id", "keep_id", "members", SHA)
    return alone.unionByName(met).select("doc_id", "keep_id", F.col("members").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col(SHA).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the copies: of equal texts the row with the smallest id stays. Only possibly repeated rows shuffle."""
    _, groups, _, maybe = _split(docs, id_col, text_col)
    rows = enclosed(docs).withColumns({"id": F.col(ROW)[id_col], SHA: text_sha256(F.col(ROW)[text_col])})
    rows = rows.withColumn(MAYBE, maybe(F.xxhash64(SHA)))
    alone = rows.where(~F.col(MAYBE)).select(ROW)
    met = rows.where(MAYBE).dropDuplicates([SHA, "id"])
    marks = groups.select(F.col(SHA).alias("kept_sha"), "keep_id")
    kept = met.join(marks, (F.col(SHA) == F.col("kept_sha")) & F.col("id").eqNullSafe(F.col("keep_id")), "left_semi")
    return released(alone.unionByName(kept.select(ROW)))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
