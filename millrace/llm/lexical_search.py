"""Ranked lexical search by TPUT over term-partitioned postings.

`build` reads every document once and writes the postings of the terms that the queries hold, a list a term in falling
order of impact (the share of a term in a document's score). The lists lie in range partitions by term and impact, so a
long list is spread over several. `search` then takes three phases:

1. The head of every list gives partial scores; the k-th best of a query is a lower bound of its k-th score. The heads'
   documents are looked up as well: the k-th best of what they really score is a second bound, closer, to prune by.
2. Every list of a query is read down to one threshold, bound / number of its lists: a document that no list shows above
   it can't reach the bound. Postings are dealt out by document, and a shard keeps, for each query, those documents whose
   upper bound (what was read, plus the least of threshold and list head for each list that didn't show it) reaches the
   better of phase 1's second bound and the k-th partial score of the shard. The k-th partial score of all then prunes again.
3. What the lists hold of these candidates below the threshold is looked up, which makes their scores exact.

The threshold comes from the first bound: with the second it would be higher, and what it hides would make upper bounds
loose. Every bound is one of scores of all documents, so no document that belongs to the result is ever left out, ties included.

Defined cases: a null text has no terms; a document without terms isn't counted. Repeated rows are documents of their own,
as are repeated items. A null doc_id stands after all others among equal scores. Items without a term that occurs have no
rows; empty tables give an empty result. Extra columns are not read. Very long texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import materialize, release, table

#: Bytes of UTF-8 to those of terms in lower case, or a space: ASCII letters and digits and all bytes beyond ASCII are of terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
FLUSH = 1 << 16  # postings that a task hands on at once
SHARD = 1 << 18  # postings of a shard of documents in phase 2, in the mean
BLOCK = 1 << 18  # terms of the queries that are searched, and broadcast, at once
LOOKUPS = 1 << 18  # candidates that are broadcast in phase 3; more are joined by shuffle


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row its terms with their counts as (uid, doc_id, n, term, tf), and one row of the term '' for its length."""
    part, row = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
    for b in batches:
        uid, docs, n, terms, tf = [], [], [], [], []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
            words = (text.as_py() or b"").translate(TERM_BYTES).split()
            if words:
                counts = Counter(words)
                counts[b""] = 0
                terms += counts.keys()
                tf += counts.values()
                for held, value in ((uid, part << 40 | row), (docs, doc_id), (n, len(words))):
                    held += [value] * len(counts)
            row += 1
            if len(terms) >= FLUSH:
                yield _postings(uid, docs, n, terms, tf)
                uid, docs, n, terms, tf = [], [], [], [], []
        if terms:
            yield _postings(uid, docs, n, terms, tf)


def _postings(uid: list, docs: list, n: list, terms: list, tf: list) -> pa.RecordBatch:
    long = pa.int64()
    return pa.RecordBatch.from_arrays([pa.array(uid, long), pa.array(docs, long), pa.array(n, long), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tf, long)], ["uid", "doc_id", "n", "term", "tf"])


def terms_of(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, doc_id, n, term, tf): the terms of each row with how often it holds them, and its length at the term ''. uid tells rows apart; it holds once the result is written."""
    return rows.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_terms, "uid long, doc_id long, n long, term string, tf long")


@dataclass
class Index:
    """postings: (tid, impact, uid) by tid and falling impact. documents: (uid, doc_id). terms: (tid, term, df, w)."""

    postings: DataFrame
    documents: DataFrame
    terms: DataFrame
    n_documents: int


def build(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Postings of the given terms (`term`, `tid`) over all documents."""
    known = terms.select("term", "tid").unionByName(docs.sparkSession.createDataFrame([("", -1)], "term string, tid long"))
    few = F.broadcast if terms.count() <= BLOCK else (lambda rows: rows)
    raw = materialize(terms_of(docs, id_col, text_col).join(few(known), "term").select("tid", "uid", "doc_id", "n", "tf"), "raw")
    size = raw.where("tid = -1").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    total, length = size["n"], size["l"] or 1
    df = raw.where("tid >= 0").groupBy("tid").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(total) + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    weights = materialize(df.withColumn("w", weight), "weights")
    m = f"(10 + (90L * n * {total}L) div {length}L)"
    scored = raw.where("tid >= 0").join(few(weights.select("tid", "w")), "tid").withColumn("impact", F.expr(f"w * ((1000000000L * tf) div (1000L * tf + 8L * {m}))")).where("impact > 0")
    lists = scored.select("tid", "impact", "uid").repartitionByRange("tid", F.desc("impact"), "uid").sortWithinPartitions("tid", F.desc("impact"), "uid")
    postings = materialize(lists, "postings")
    documents = materialize(raw.where("tid = -1").select("uid", "doc_id"), "lengths")
    release(raw)
    return Index(postings, documents, terms.join(weights, "tid"), total)


def _kth(scores: DataFrame, value: str, k: int, name: str) -> DataFrame:
    """(qid, name): the k-th largest value of a query, for those with so many."""
    at = Window.partitionBy("qid").orderBy(F.desc(value))
    return scores.withColumn("at", F.row_number().over(at)).where(F.col("at") <= k).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min(value).alias(name)).where(F.col("n") == k).drop("n")


def _shard(queries: list[tuple[int, np.ndarray, np.ndarray, int, int]], k: int):
    """Phase 2 in a shard: queries are (qid, tids, heads, threshold, floor)."""

    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group["tid"].to_numpy(), kind="stable")
        tid, impact = group["tid"].to_numpy()[order], group["impact"].to_numpy()[order]
        uids, place = np.unique(group["uid"].to_numpy()[order], return_inverse=True)
        out = []
        for qid, tids, heads, threshold, floor in queries:
            starts, stops = np.searchsorted(tid, tids), np.searchsorted(tid, tids, "right")
            partial, missing = np.zeros(len(uids), np.int64), np.full(len(uids), np.minimum(heads, threshold - 1).sum(), np.int64)
            for lo, hi, head in zip(starts, stops, heads, strict=True):
                shown = lo + np.flatnonzero(impact[lo:hi] >= threshold)
                partial[place[shown]] += impact[shown]  # a list shows a document once
                missing[place[shown]] -= min(head, threshold - 1)
            best = int(np.partition(partial, -k)[-k]) if len(partial) >= k else 0
            kept = np.flatnonzero((partial > 0) & (partial + missing >= max(floor, best)))
            out.append((np.full(len(kept), qid, np.int64), uids[kept], partial[kept], partial[kept] + missing[kept]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table(dict(zip(["qid", "uid", "partial", "upper"], columns, strict=True)))

    return run


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """(qid, rank, doc_id, score) of the k best documents of each query. queries: (qid, tid), each pair once."""
    blocks = -(-queries.count() // BLOCK) or 1
    found = [_search(index, queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i) if blocks > 1 else queries, k) for i in range(blocks)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    spark, postings = queries.sparkSession, index.postings
    # Phase 1. A list's head is k postings, whatever its length: partial limits cut it in every partition.
    head = Window.partitionBy("tid").orderBy(F.desc("impact"))
    mine = F.broadcast(queries.select("tid").distinct())  # a block's
    heads = materialize(postings.join(mine, "tid").withColumn("at", F.row_number().over(head)).where(F.col("at") <= k), "heads")
    lists = queries.join(heads.groupBy("tid").agg(F.max("impact").alias("head")), "tid")
    partial = materialize(queries.join(heads, "tid").groupBy("qid", "uid").agg(F.sum("impact").alias("partial")), "partial")
    # The documents at the heads, k * BLOCK at most, are also looked up: what they really score is a better bound to prune by.
    owners = postings.join(F.broadcast(partial.select("qid", "uid")), "uid").join(F.broadcast(queries), ["qid", "tid"])
    real = owners.groupBy("qid", "uid").agg(F.sum("impact").alias("score"))
    bounds = _kth(partial, "partial", k, "bound").join(_kth(real, "score", k, "floor"), "qid")
    # Lists of a query in one row: as many as its terms. Queries of a block have BLOCK terms at most.
    known = lists.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("tid", "head"))).alias("lists")).join(bounds, "qid", "left")
    asked = []
    for row in known.collect():
        tids, tops = (np.array([x[c] for x in row["lists"]], np.int64) for c in ("tid", "head"))
        bound = row["bound"] or 0
        asked.append((row["qid"], tids, tops, max(1, -(-bound // len(tids))), row["floor"] or 0))
    if not asked:
        return spark.createDataFrame([], "qid long, rank int, doc_id long, score long")
    # Phase 2. Down to the least threshold of the queries that hold the term.
    schema = "qid long, tid long, threshold long"
    limits = spark.createDataFrame([(int(q), int(t), int(at)) for q, tids, _, at, _ in asked for t in tids], schema)
    least = limits.groupBy("tid").agg(F.min("threshold").alias("least"))
    read = postings.join(F.broadcast(least), "tid").where("impact >= least").select("tid", "impact", "uid")
    shards = max(1, index.postings.count() // SHARD)
    dealt = read.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)))
    shared = spark.sparkContext.broadcast(asked)
    candidates = materialize(dealt.groupBy("shard").applyInArrow(lambda group: _shard(shared.value, k)(group.drop(["shard"])), "qid long, uid long, partial long, upper long"), "candidates")
    better = _kth(candidates, "partial", k, "reached")
    left = candidates.join(F.broadcast(better), "qid", "left").where("reached is null or upper >= reached").select("qid", "uid", "partial")
    left = materialize(left, "left")
    # Phase 3. What the threshold hid of the candidates.
    few = left.count() <= LOOKUPS
    wanted = F.broadcast(left.select("qid", "uid")) if few else left.select("qid", "uid")
    looked = postings.join(wanted, "uid").join(F.broadcast(limits), ["qid", "tid"]).where("impact < threshold").select("qid", "uid", "impact")
    scores = left.withColumnRenamed("partial", "impact").unionByName(looked).groupBy("qid", "uid").agg(F.sum("impact").alias("score"))
    names = index.documents.join(F.broadcast(left.select("uid").distinct()) if few else left.select("uid").distinct(), "uid")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "uid")
    return scores.join(names, "uid").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("qid", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents for each item (item_id, text)."""
    asked = materialize(terms_of(items, "item_id", "text").where("term <> ''").select(F.col("uid").alias("qid"), F.col("doc_id").alias("item_id"), "term"), "queries")
    terms = materialize(asked.select("term").distinct().select("term", F.monotonically_increasing_id().alias("tid")), "terms")
    queries = materialize(asked.join(terms, "term").select("qid", "tid"), "lists")
    found = search(build(docs, terms), queries, k)
    return found.join(asked.select("qid", "item_id").distinct(), "qid").select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
