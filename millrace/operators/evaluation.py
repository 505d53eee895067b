"""Graded cases over a corpus: presence of passages, and pass counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squeezed(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")


def _word_runs(text: Column, words: int) -> Column:
    """A hash of each run of `words` words. The words are hashed once: a lambda's argument is computed once, an expression that is named twice isn't."""

    def runs(hashes: Column) -> Column:
        count = F.greatest(F.size(hashes) - words + 1, F.lit(0))
        out = F.slice(hashes, F.lit(1), count)
        for k in range(1, words):
            out = F.zip_with(out, F.slice(hashes, F.lit(k + 1), count), lambda a, b: F.xxhash64(a, b))
        return out

    return F.get(F.transform(F.array(F.transform(F.split(text, " "), lambda w: F.xxhash64(w))), runs), F.lit(0))


def presence(cases: DataFrame, docs: DataFrame, case_id: str, doc_id: str, text: str = "text", words: int = 4) -> DataFrame:
    """hits and present for each case: documents whose text holds the case's, regardless of case and spacing.

    A case meets only documents that share its second run of whole words, by an equi-join of ids on hashes of all runs of
    that length; texts join the pairs that met, and the containment is then checked on them. Cases too short for two runs
    are checked on every text."""
    asked = cases.select(case_id, squeezed(F.col(text)).alias("__case")).withColumn("__runs", _word_runs(F.col("__case"), words))
    asked = asked.withColumn("__key", F.when(F.size("__runs") > 2, F.get("__runs", F.lit(1)))).drop("__runs")  # the first and last words may go on in the text
    short = F.col("__key").isNull()
    rows = docs.select(doc_id, squeezed(F.col(text)).alias("__text"))
    keyed = rows.select(doc_id, F.explode(F.array_distinct(_word_runs(F.col("__text"), words))).alias("__key"))
    pairs = keyed.join(asked.where(~short).select(case_id, "__key"), "__key").select(case_id, doc_id).distinct()
    met = pairs.join(rows, doc_id).join(asked.select(case_id, "__case"), case_id).where(F.contains("__text", "__case")).select(case_id, doc_id).distinct()
    brief = asked.where(short).select(case_id, "__case").join(rows, F.contains("__text", "__case")).select(case_id, doc_id).distinct()
    hits = met.unionByName(brief).groupBy(case_id).agg(F.count(F.lit(1)).alias("hits"))
    return cases.select(case_id).join(hits, case_id, "left").select(case_id, F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), F.col("hits").isNotNull().alias("present"))


def all_present(text: Column, wanted: Column) -> Column:
    """Whether a text holds every wanted string."""
    return F.forall(wanted, lambda w: F.contains(squeezed(text), squeezed(w)))
