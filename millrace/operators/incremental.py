"""Incremental work: de-duplication keys, merges into stored tables, resumable candidates, versions, batches.

Plain Parquet has no MERGE, so a merge is a join or a union with a window that gives the new table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.rounds import written


def first_seen(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def manifest_status(entries: DataFrame, order: list) -> DataFrame:
    """Fate of each download: a URL that was seen is skipped, a body that was seen is recorded without storing it again.

    A row that is skipped is never fetched, so its body isn't seen by it. Policies go by URL and body together: two
    policies may share a text, and an amendment is a new text under an old URL."""
    seen = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1
    policy = F.col("doc_type") == "policy"
    df = entries.withColumn("__skipped", F.when(policy, seen("doc_type", "source_url", "sha256")).otherwise(seen("source_url")))
    df = df.withColumn("__body", seen("sha256", "__skipped"))
    return df.withColumn("fate", F.when(F.col("__skipped"), "skipped").when(~policy & F.col("__body"), "recorded").otherwise("stored")).drop("__skipped", "__body")


def new_rows(found: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't stored: once each."""
    return found.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], keep_old: bool = True) -> DataFrame:
    """stored with the new values; where a new value is null the old one stays, unless keep_old is off."""
    values = [c for c in stored.columns if c not in keys]
    a = stored.select(*keys, *(F.col(c).alias(f"__old_{c}") for c in values), F.lit(True).alias("__old"))
    b = new.select(*keys, *(F.col(c).alias(f"__new_{c}") for c in values), F.lit(True).alias("__new"))
    both = a.join(b, keys, "full_outer")
    value = lambda c: F.coalesce(f"__new_{c}", f"__old_{c}") if keep_old else F.when(F.col("__new"), F.col(f"__new_{c}")).otherwise(F.col(f"__old_{c}"))
    return both.select(*keys, *(value(c).alias(c) for c in values))


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with one key the last written, whole."""
    return first_seen(rows, keys, [F.col(order).desc()])


def find_or_insert(stored: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Every found key with the stored status, and whether it was new. A stored row without a status is known and pending."""
    old = stored.select(*keys, F.col("status").alias("__status"), F.lit(True).alias("__known"))
    df = found.dropDuplicates(keys).join(old, keys, "left")
    return df.withColumn("was_new", F.col("__known").isNull()).withColumn("status", F.coalesce("__status", F.lit("pending"))).drop("__status", "__known")


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """rows without those of the given keys: what a delete leaves."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def replaced(rows: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the updates' values where a key has one: a bulk update that adds no rows."""
    values = [c for c in updates.columns if c not in keys]
    new = updates.select(*keys, F.struct(*values).alias("__new"))
    value = lambda c: F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c))
    return rows.join(new, keys, "left").select(*(value(c).alias(c) if c in values else F.col(c) for c in rows.columns))


def next_index(rows: DataFrame, key: str, index: str) -> DataFrame:
    return rows.groupBy(key).agg((F.max(index) + 1).alias("next_index"))


def resumable(documents: DataFrame, chunks: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Ingested documents that are not processed and have no table chunk; by group, newest first, undated last."""
    tables = chunks.where("kind = 'table'").select(key).distinct()
    left = documents.where("status = 'ingested' and processed_at is null").join(tables, key, "left_anti")
    ordered = left.orderBy("slug", F.col("day").desc_nulls_last(), key)
    return ordered if most is None else ordered.limit(most)


#: What names a table of salaries or extra pay, as whole words where the words are short.
CANDIDATE = r"salary|stipend|longevity|coach|extra.?duty|co.?curricular|\b(?:ba|ma)\s*\+?\s*\d{2}\b|\bph\.?\s*d\b|\bdoctorate\b|\bstep\b"


def extraction_candidates(chunks: DataFrame, documents: DataFrame, key: str, chunk_key: str, only_new: bool = True, group: str | None = None, most: int | None = None) -> DataFrame:
    """Active table chunks that a keyword names in content, heading or title, by group, newest first, undated last.

    chunks: chunk_key, key, kind, status, content, heading, extracted_at; documents: key, slug, title, day. What is extracted already stays out, so a stopped pass goes on where it was."""
    tables = chunks.where("kind = 'table' and status = 'active'")
    if only_new:
        tables = tables.where("extracted_at is null")
    if group is not None:
        documents = documents.where(F.col("slug") == group.strip())
    named = F.lit(False)
    for c in ("content", "heading", "title"):
        named = named | F.coalesce(F.col(c).rlike(f"(?i){CANDIDATE}"), F.lit(False))
    ordered = tables.join(documents, key).where(named).orderBy("slug", F.col("day").desc_nulls_last(), chunk_key)
    return ordered if most is None else ordered.limit(most)


def reclassified(documents: DataFrame, chunks: DataFrame, key: str, kind: Column) -> tuple[DataFrame, DataFrame]:
    """Documents of type other with the type that a rule finds, and all chunks with the type of their document."""
    found = F.when((F.col("doc_type") == "other") & kind.isNotNull(), kind).otherwise(F.col("doc_type"))
    new = documents.withColumn("doc_type", found)
    types = new.select(key, F.col("doc_type").alias("__type"))
    carried = chunks.join(types, key, "left").withColumn("doc_type", F.coalesce("__type", "doc_type")).drop("__type")
    return new, carried.select(*chunks.columns)


def marked(documents: DataFrame, updates: DataFrame, key: str, now: Column) -> DataFrame:
    """documents with status and error of the updates, a null leaving the old value; ingested_at is set where an update says ingested."""
    new = updates.select(key, F.col("status").alias("__status"), F.col("error").alias("__error"))
    df = documents.join(new, key, "left")
    at = F.when(F.col("__status") == "ingested", now).otherwise(F.col("ingested_at"))
    return df.withColumns({"ingested_at": at, "status": F.coalesce("__status", "status"), "error": F.coalesce("__error", "error")}).select(*documents.columns)


def touched(stored: DataFrame, written: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """stored with the written rows' values; updated_at is now on every row that was written, whatever the write says."""
    new = written.drop("updated_at").withColumn("updated_at", now)
    return replaced(stored, new, keys)


def backfill(documents: DataFrame, chunks: DataFrame, key: str, value: Column, out: str) -> DataFrame:
    """documents with a marker where a table chunk exists."""
    has = chunks.where("kind = 'table'").select(key).distinct().withColumn("__has", F.lit(True))
    return documents.join(has, key, "left").withColumn(out, F.when(F.col("__has"), value).otherwise(F.col(out))).drop("__has")


def changes(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """NEW, UNCHANGED, UPDATED or GONE by the hash of the normalised text."""
    digest = F.sha2(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")), 256)
    a, b = old.select(key, digest.alias("a")), new.select(key, digest.alias("b"))
    both = a.join(b, key, "full_outer")
    return both.select(key, F.when(F.col("a").isNull(), "NEW").when(F.col("b").isNull(), "GONE").when(F.col("a") == F.col("b"), "UNCHANGED").otherwise("UPDATED").alias("change"))


def current_versions(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """rows with is_current: true on a key's newest version."""
    newest = F.max(version).over(Window.partitionBy(*keys))
    return rows.withColumn("is_current", F.col(version) == newest)


def rate_limited(calls: DataFrame, window: float, most: int, key: str = "key", at: str = "at") -> DataFrame:
    """calls with `allowed`: a call is refused if its key has `most` allowed ones in the window before it. Refused calls aren't recorded,
    so the state is recursive and a window count can't tell. A key's calls come in order and only `most` times are held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, log = None, []
        for pdf in batches:
            allowed = []
            for k, t in zip(pdf[key], pdf[at], strict=True):
                if k != current:
                    current, log = k, []
                log = [s for s in log if t - s < window]
                ok = len(log) < most
                if ok:
                    log.append(t)
                allowed.append(ok)
            yield pdf.assign(allowed=allowed)

    schema = calls.withColumn("allowed", F.lit(True)).schema
    others = [c for c in calls.columns if c not in (key, at)]
    return calls.repartition(key).sortWithinPartitions(key, at, *others).mapInPandas(run, schema)


def packed(texts: DataFrame, order: str, text: str = "text", most_inputs: int = 128, most_tokens: int = 250_000, per_token: float = 1.5, cap: int = 32_000) -> DataFrame:
    """texts with the request (`batch`) they go to: filled in the order of a column that tells rows apart, up to a number of inputs and of estimated tokens, as one walk over all would. Blank texts get no request.

    A range-sorted partition is a function of what is open before it: the rows that still go there, at most `most_inputs`, decide all later cuts. Each partition tabulates its function, the tables are composed in order, and each partition then numbers its own rows. Only row ids and token counts reach Python."""
    spoken = F.coalesce(F.col(text).rlike(r"(?U)\S"), F.lit(False))
    tokens = F.least(F.floor(F.char_length(text) / per_token).cast("int") + 1, F.lit(cap))
    rows = texts.where(spoken).select(F.col(order).alias("key"), tokens.alias("n"))
    dealt = written(rows.repartitionByRange("key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id()), "packed")

    def nexts(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For a request that begins at each row, the row that begins the next; and the sums before each row."""
        sums = np.concatenate([[0], np.cumsum(n)])
        full = np.searchsorted(sums, sums[:-1] + most_tokens, "right") - 1
        return np.minimum(np.maximum(full, np.arange(len(n)) + 1), np.arange(len(n)) + most_inputs), sums

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each number of rows that go to what is open before: the requests begun after them, and what the last leaves open."""
        n = pdf.sort_values("key")["n"].to_numpy()
        after, sums = nexts(n)
        size, entries = len(n), min(most_inputs, len(n))
        begun, last = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
        for i in range(size - 1, -1, -1):
            j = after[i]
            begun[i], last[i] = (1, i) if j >= size else (begun[j] + 1, last[j])
        e = np.arange(entries + 1)
        at = np.where(begun[e] > 0, last[e], 0)
        return pd.DataFrame({"part": pdf["part"].iloc[0], "entry": e, "before": sums[e], "begun": begun[e], "inputs": np.where(begun[e] > 0, size - at, size), "tokens": np.where(begun[e] > 0, sums[size] - sums[at], sums[size])})

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        inputs, total, batch, out = 0, 0, -1, []
        for part, t in pdf.groupby("part", sort=True):
            t = t.sort_values("entry")
            fits = (t["before"].to_numpy() + total <= most_tokens) & (t["entry"].to_numpy() + inputs <= most_inputs)
            entry = int(np.flatnonzero(fits).max(initial=0)) if inputs else 0
            row = t.iloc[entry]
            out.append((part, entry, batch))
            batch += int(row["begun"])
            inputs, total = (int(row["inputs"]), int(row["tokens"])) if row["begun"] else (inputs + int(row["inputs"]), total + int(row["tokens"]))
        return pd.DataFrame(out, columns=["part", "entry", "open"])

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        after, _ = nexts(pdf["n"].to_numpy())
        begins, at = np.zeros(len(pdf), np.int64), int(pdf["entry"].iloc[0])
        while at < len(pdf):
            begins[at] = 1
            at = int(after[at])
        return pd.DataFrame({"key": pdf["key"], "batch": pdf["open"] + np.cumsum(begins)})

    tables = dealt.groupBy("part").applyInPandas(table, "part int, entry int, before long, begun long, inputs long, tokens long")
    starts = tables.groupBy().applyInPandas(compose, "part int, entry int, open int")  # most_inputs rows a partition
    numbered = dealt.join(F.broadcast(starts), "part").groupBy("part").applyInPandas(number, f"key {dict(rows.dtypes)['key']}, batch int")
    return texts.join(numbered.withColumnRenamed("key", order), order, "left")
