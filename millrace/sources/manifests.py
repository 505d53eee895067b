"""Manifests, snapshots, crosswalks, word lists, targets and frontiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.rounds import written

MANIFEST = "district string, doc_type string, title string, source_url string, local_path string, sha256 string, size_bytes long, content_type string, date date, meeting_id string, committee string, fetched_at timestamp"
SNAPSHOT = "district string, title string, source_url string, fetched_at string, html string"
DOC_TYPES = ["minutes", "transcript", "agenda", "policy", "handbook", "contract", "budget", "other"]


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """All manifest.jsonl files below a folder; a broken line or an unknown type fails the read."""
    rows = spark.read.schema(MANIFEST).option("mode", "FAILFAST").option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.jsonl").json(root)
    known = F.col("doc_type").isin(DOC_TYPES)
    return rows.withColumn("doc_type", F.when(known, F.col("doc_type")).otherwise(F.raise_error(F.concat(F.lit("unknown doc_type: "), F.coalesce("doc_type", F.lit("null"))))))


def gathered(entries: list[DataFrame], district: str | None = None, doc_type: str | None = None, most: int | None = None) -> DataFrame:
    """Entries of explicit manifests, then of found ones: each URL and body once, filtered, the first `most`."""
    rows = None
    for i, e in enumerate(entries):
        e = e.withColumn("__source", F.lit(i))
        rows = e if rows is None else rows.unionByName(e)
    w = Window.partitionBy("source_url", "sha256").orderBy("__source")
    rows = rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1")
    if district is not None:
        rows = rows.where(F.col("district") == district)
    if doc_type is not None:
        rows = rows.where(F.col("doc_type") == doc_type)
    rows = rows.orderBy("__source", "district", "source_url", "sha256")
    return (rows if most is None else rows.limit(most)).drop("__source", "__rn")


def relative_path(path: Column) -> Column:
    """Last three parts of a recorded path: where the file lies beside its manifest."""
    return F.array_join(F.slice(F.split(path, "/"), -3, 3), "/")


def resolved(entries: DataFrame, files: DataFrame) -> DataFrame:
    """entries with the path that exists: the recorded one, else the same last three parts in a listing (path)."""
    exact = files.select(F.col("path").alias("__exact"))
    tail = files.withColumn("__tail", relative_path(F.col("path"))).groupBy("__tail").agg(F.min("path").alias("__other"))
    met = entries.join(exact, F.col("local_path") == F.col("__exact"), "left").join(tail, relative_path(F.col("local_path")) == F.col("__tail"), "left")
    return met.withColumn("path", F.coalesce("__exact", "__other")).drop("__exact", "__other", "__tail")


def snapshot(spark: SparkSession, path: str, stored: DataFrame | None = None) -> DataFrame:
    """A gzipped JSON-lines snapshot with the hash of each body; what is stored under the same URL and hash is left out."""
    rows = spark.read.schema(SNAPSHOT).json(path).withColumn("sha256", F.sha2("html", 256)).dropDuplicates(["source_url", "sha256"])
    return rows if stored is None else rows.join(stored.select("source_url", "sha256"), ["source_url", "sha256"], "left_anti")


def store_path(entries: DataFrame) -> Column:
    """<district>/<type>/<first eight of the hash>_<slug>."""
    from millrace.functions.text import slug

    return F.concat_ws("/", slug(F.col("district")), F.col("doc_type"), F.concat_ws("_", F.substring("sha256", 1, 8), slug(F.col("title"))))


def append_manifest(entries: DataFrame, folder: str) -> None:
    entries.write.mode("append").json(folder)


def crosswalk(spark: SparkSession, path: str) -> DataFrame:
    """district_slug (null for all), lane_raw (clean) and lane_canonical; # lines are comments."""
    from millrace.functions.taxonomy import clean

    rows = spark.read.schema("district_slug string, lane_raw string, lane_canonical string").option("header", True).option("comment", "#").csv(path)
    rows = rows.select(F.nullif(F.trim("district_slug"), F.lit("")).alias("district_slug"), clean(F.col("lane_raw")).alias("lane_raw"), F.trim("lane_canonical").alias("lane_canonical"))
    return rows.where("lane_raw <> '' and lane_canonical <> ''").dropDuplicates(["district_slug", "lane_raw"])


def word_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def targets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def sampled(rows: DataFrame, most: int, seed: int, key: str) -> DataFrame:
    """A seeded random sample that doesn't depend on partitions: the first rows in the order of a hash of the key."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(most)


def crawl(edges: DataFrame, seeds: DataFrame, depth: int, most: int, host: str) -> DataFrame:
    """Breadth-first frontier over known links (url, target) from seeds (url): each page with its depth, bound to a host.

    Each round is written and reads the one before it. The walk stops at the depth, where nothing new is found, or with the round that reaches `most` pages, of which the first by url are taken."""
    inside = lambda c: F.regexp_extract(c, r"://([^/?#]*)", 1) == host
    front = written(seeds.select("url").distinct().where(inside(F.col("url"))).withColumn("depth", F.lit(0)), "frontier")
    seen, n = front, front.count()
    for d in range(1, depth + 1):
        if n >= most:
            break
        found = front.join(edges, "url").select(F.col("target").alias("url")).distinct().where(inside(F.col("url")))
        front = written(found.join(seen, "url", "left_anti").withColumn("depth", F.lit(d)), "frontier")
        more = front.count()
        if not more:
            break
        seen, n = seen.unionByName(front), n + more
    return seen.orderBy("depth", "url").limit(most)
