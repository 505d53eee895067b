"""Training-data pipeline: toxicity, exact dedup, n-gram Jaccard join, secret scans, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet in the shared folder and
reads again as the next stage's docs. All but the last return the columns of documents. Further columns of docs pass
through, whatever their names; an empty table gives an empty result at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, ngram_join, packing, secrets, toxicity
from millrace.llm.common import ROW, enclosed, materialize, released, table

TOKENIZER, END_ID, CAPACITY = public_tokenizers.path("word_bpe_49k.json"), 1, 4096


def _modest(spark: SparkSession) -> None:
    """Texts pass to Python in small Arrow batches: an executor's workers share its memory with what five stages leave."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model finds toxic go. A null or empty text has the severity of the thresholds alone and stays; repeated rows fare alike."""
    _modest(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    rows = enclosed(docs).withColumn("text", F.col(ROW)["text"])
    return released(toxicity.score(rows, model).where("not toxic"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one with the smallest doc_id. Null and empty texts are one group."""
    return exact_dedup.deduplicate(docs)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links stays, the one with the smallest doc_id. Words, five a shingle, and a similarity of 0.8. Texts without words stay, and so do rows without doc_id."""
    return ngram_join.deduplicate(docs, percent=80, n=5)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; each secret becomes [secret], and n_chars follows the text. A null text stays null."""
    rows = secrets.scanned(docs)
    row, found = F.col(ROW), F.size("spans") > 0
    rows = rows.withColumn("text", F.when(found, secrets.redact(row["text"], F.col("spans"))).otherwise(row["text"]))
    changed = {"text": F.col("text"), "n_chars": F.when(found, F.char_length("text").cast("long")).otherwise(row["n_chars"])}
    return rows.select(*(changed.get(c, row[c]).alias(c) for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 4096 tokens. A null text is empty and gives the end id alone."""
    return packing.plan(docs, TOKENIZER, END_ID, CAPACITY)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("secret_scans", secret_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL has no trained severity model and no packing search; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
