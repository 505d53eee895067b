"""N-gram Jaccard join: size-aware, heavy-light, exact.

A document's set holds its distinct word n-grams as 64-bit hashes. Equal sets form one class first, and the smallest
doc_id stands for it. Small sets (light) enumerate, for each size of partner, their subsets of the least overlap that
the threshold asks for: two sets link exactly if they share one. Large sets (heavy) post their rarest n-grams to
inverted lists, as many as make two linked sets meet in a list, and the lists are scanned. The boundary is the size at
which enumeration plus scanning costs least, from the sizes of all sets. Every candidate is checked on all n-grams of the
whole texts, as 64-bit hashes.

No list is expanded into all its pairs. Each is held against its pivot, the member that meets most others. Jaccard
distance is a metric, so a member that links with the pivot and one that doesn't can link only if their distances to the
pivot differ by no more than the threshold's: those few pairs are checked unless they are in one component already, and
the members that link are done with. The others make a shorter list with pivots of its own, four times as many each round (up
to PIVOTS), until no more pairs are left than there are postings: rounds grow with the logarithm of the longest list. Two linked sets first meet at a place in both prefixes that leaves room for their overlap; at
other places a pair is left to that list.

The result has one row a document with its class (component_id, the smallest doc_id reachable by links) and n_shingles.
Defined cases: null, empty and blank texts have an empty set and link with nothing. A null doc_id links with nothing
and has a null component_id. Rows that repeat a doc_id with other texts are each a member, and classes with the same
smallest doc_id count as linked. Extra columns aren't carried by `classes`, and stay in `deduplicate`, whatever their
names. Very long texts are taken whole; memory grows with one text's n-grams. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import bloom
from millrace.llm.common import ROW, enclosed, lookup, materialize, release, released, small_batches, table
from millrace.llm.components import components

SKETCH_MAX, SKETCH_BLOCK = 1 << 26, 1 << 14  # counters of the n-gram frequency sketch at most, and counters a block
SMALL = 64  # sizes for which enumeration is considered
SETS = "doc_id long, n int, key binary, tokens array<long>, subsets array<long>"
PIVOTS = 1024  # pivots of a list in one round, at most
SHARE = 2048  # rows of a list that one task pairs with the rest of it
CHECK = 20  # cost of checking a candidate, which reads two texts, in postings


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, n: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; A-Z lower-cased, words split at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    count = len(h) - n + 1
    with np.errstate(over="ignore"):
        s = np.zeros(count, np.uint64)
        for k in range(n):
            s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + h[k : k + count])
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


class Rule:
    """Links at percent * union <= 100 * intersection."""

    def __init__(self, percent: int):
        self.percent = percent

    def overlap(self, a: int, b: int) -> int:
        """Least intersection of linked sets of sizes a and b."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def partners(self, a: int) -> range:
        """Sizes of sets that may link with a set of size a."""
        return range(-(-self.percent * a // 100), 100 * a // self.percent + 1)

    def prefix(self, a: int) -> int:
        """Rarest n-grams of which two linked sets share one."""
        return a - -(-self.percent * a // 100) + 1

    def subsets(self, a: int) -> int:
        """Subsets that a set of size a enumerates."""
        return sum(comb(a, self.overlap(a, b)) for b in self.partners(a) if self.overlap(a, b) <= min(a, b) and not a == b == self.overlap(a, b))

    def boundary(self, sizes: dict[int, int], larger: int) -> int:
        """Largest size that enumerates: the one of least cost. sizes: sets by size up to SMALL; larger: cost of the others."""
        enumerate_ = lambda s: sizes.get(s, 0) * self.subsets(s)
        scan = lambda s: sizes.get(s, 0) * (self.prefix(s) + CHECK)
        cost = lambda x: sum(map(enumerate_, range(1, x + 1))) + sum(scan(s) for s in range(self.partners(x + 1)[0], SMALL + 1)) + larger
        return min(range(SMALL), key=cost)

    def keys(self, s: np.ndarray) -> list[int]:
        """Hashes of the subsets that s enumerates, with the sizes they stand for."""
        a, out = len(s), []
        with np.errstate(over="ignore"):
            whole = s.sum(dtype=np.uint64)
            for b in self.partners(a):
                c = self.overlap(a, b)
                if c > min(a, b) or a == b == c:
                    continue
                gone = np.array(list(itertools.combinations(range(a), a - c)), np.int64).reshape(comb(a, c), a - c)
                subset = whole - s[gone].sum(axis=1, dtype=np.uint64)
                out.append(_mix(subset + np.uint64(min(a, b) * 1009 + max(a, b))))
        return np.concatenate(out).astype(np.int64).tolist() if out else []


def _sketch(docs: DataFrame, n: int) -> tuple[np.ndarray, dict[int, int], int]:
    """Frequency class of each counter (a logarithm of its count) over all n-grams of all documents, the number of sets
    by size up to SMALL, and the n-grams of larger ones. A counter is not below the frequency of an n-gram it counts, so
    n-grams with low counters stand in short lists; in each task it ends at 255, which lists can only be the longer for.
    64 counters a document, a byte each in tasks and in what is broadcast, SKETCH_MAX at most."""
    blocks = min(SKETCH_MAX // SKETCH_BLOCK, max(4, -(-64 * docs.count() // SKETCH_BLOCK)))
    cells = np.uint64(blocks * SKETCH_BLOCK)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sizes = np.zeros(blocks * SKETCH_BLOCK, np.uint8), np.zeros(SMALL + 2, np.int64)
        for b in batches:
            for t in b.column(0):
                s = shingles(t.as_py(), n)
                at = (s % cells).astype(np.int64)
                counts[at] = np.minimum(counts[at], 254) + 1  # n-grams of a text that share a counter count once
                sizes[min(len(s), SMALL + 1)] += 1 if len(s) <= SMALL else len(s)
        zstd = zstandard.ZstdCompressor()
        rows = [zstd.compress(counts[k * SKETCH_BLOCK : (k + 1) * SKETCH_BLOCK]) for k in range(blocks)] + [zstd.compress(sizes)]
        yield pa.RecordBatch.from_arrays([pa.array(range(blocks + 1), pa.int32()), pa.array(rows, pa.binary())], ["block", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd, current, total = zstandard.ZstdDecompressor(), None, None
        # Up to 64 the count itself, above it sixteen steps a doubling: one byte
        level = lambda c: np.where(c < 64, c, 64 + 16 * np.log2(np.maximum(c, 64) / 64)).clip(0, 255).astype(np.uint8)
        out = lambda: pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([(total if current == blocks else level(total)).tobytes()], pa.binary())], ["block", "counts"])
        for b in batches:
            for block, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                part = np.frombuffer(zstd.decompress(data), np.int64 if block == blocks else np.uint8).astype(np.int64)
                if block != current:
                    if current is not None:
                        yield out()
                    current, total = block, part
                else:
                    total = total + part
        if current is not None:
            yield out()

    schema = "block int, counts binary"
    with small_batches(docs.sparkSession):
        merged = docs.select("text").mapInArrow(count, schema).repartition("block").sortWithinPartitions("block").mapInArrow(merge, schema).collect()
    found = {r[0]: r[1] for r in merged}  # SKETCH_MAX bytes at most
    rank = np.concatenate([np.frombuffer(found[k], np.uint8) if k in found else np.zeros(SKETCH_BLOCK, np.uint8) for k in range(blocks)])
    sizes = np.frombuffer(found[blocks], np.int64) if blocks in found else np.zeros(SMALL + 2, np.int64)
    return rank, {s: int(sizes[s]) for s in range(1, SMALL + 1)}, int(sizes[SMALL + 1])


def _sets(docs: DataFrame, rule: Rule, n: int) -> DataFrame:
    """doc_id, size, class key, posted n-grams and enumerated subsets of each document."""
    spark = docs.sparkSession
    rank, sizes, larger = _sketch(docs, n)
    light = rule.boundary(sizes, larger)
    heavy = rule.partners(light + 1)[0]  # the smallest size that may link with one above the boundary
    ranks = spark.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.uint64(len(ranks.value))
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                rows = []
                for i, t in zip(b.column(0).slice(lo, 500).to_pylist(), b.column(1).slice(lo, 500), strict=True):
                    s = shingles(t.as_py(), n)
                    tokens: list[int] = []
                    if len(s) >= heavy:
                        order = np.lexsort((s, ranks.value[(s % cells).astype(np.int64)]))
                        tokens = s[order[: rule.prefix(len(s))]].astype(np.int64).tolist()
                    rows.append((i, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), tokens, rule.keys(s) if 0 < len(s) <= light else []))
                types = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "n", "key", "tokens", "subsets"])

    with small_batches(spark):
        out = materialize(docs.mapInArrow(run, SETS), "sets")
    ranks.destroy()
    return out


def _verified(pairs: DataFrame, docs: DataFrame, rule: Rule, n: int) -> DataFrame:
    """The pairs (u, v) with their distance and whether they link, by the n-grams of their whole texts.

    Only texts that a Bloom filter of the pairs' ids lets through are read for it; their sets meet as arrays in the JVM."""
    spark = docs.sparkSession
    pairs = materialize(pairs.distinct(), "pairs")
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    involved = spark.sparkContext.broadcast(bloom.repeated_filter(ids.select(F.explode(F.array_repeat(F.xxhash64("id"), 2))), 2 * pairs.count()))

    @F.pandas_udf("boolean")
    def maybe(s: pd.Series) -> pd.Series:
        return pd.Series(involved.value.maybe(s.to_numpy()))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 100):
                found = [shingles(t.as_py(), n).view(np.int64) for t in b.column(1).slice(lo, 100)]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 100), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))], ["id", "grams"])

    with small_batches(spark):
        texts = docs.where(F.col("doc_id").isNotNull()).where(maybe(F.xxhash64("doc_id")))
        sets = materialize(texts.mapInArrow(grams, "id long, grams array<long>"), "grams")
    met = pairs.join(sets.select(F.col("id").alias("v"), F.col("grams").alias("y")), "v")
    met = met.join(sets.select(F.col("id").alias("u"), F.col("grams").alias("x")), "u")
    met = met.select("u", "v", F.size(F.array_intersect("x", "y")).cast("long").alias("common"), (F.size("x") + F.size("y")).cast("long").alias("sizes"))
    union = F.col("sizes") - F.col("common")
    met = met.select("u", "v", (1 - F.col("common") / F.greatest(union, F.lit(1))).alias("d"), ((F.col("common") > 0) & (100 * F.col("common") >= rule.percent * union)).alias("linked"))
    out = materialize(met.groupBy("u", "v").agg(F.min("d").alias("d"), F.max("linked").alias("linked")), "verified")
    release(pairs, sets)
    involved.destroy()
    return out


def _stars(rows: DataFrame, key: str, order: list, most: int = 1) -> DataFrame:
    """(u, v): pivots of each key, the first `most` by `order`, with each other member. `pivot` tells members that are pivots themselves; a pair of them stands once."""
    first = F.struct(*order, F.col("n").alias("pn"), F.col("id").alias("u"))
    if most == 1:
        pivots = rows.groupBy(key).agg(F.array(F.min(first)).alias("p"), F.count(F.lit(1)).alias("members"))
    else:
        ahead = rows.select(key, first.alias("x")).withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy("x"))).where(F.col("at") <= most)
        pivots = ahead.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("p")).join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("members")), key)  # `most` at most
    pivots = materialize(pivots.where("members > 1").select(key, "members", F.transform("p", lambda x: F.struct(x["pn"].alias("pn"), x["u"].alias("u"))).alias("p")), "pivots")
    met = lookup(rows, key, pivots, max(1, rows.count())).where("members is not null").withColumn("pivot", F.exists("p", lambda x: x["u"] == F.col("id")))
    met = met.withColumn("p", F.explode("p")).select(*(c for c in met.columns if c != "p"), F.col("p.pn").alias("pn"), F.col("p.u").alias("u"))
    return met.where("u <> id and (not pivot or u < id)")


def _fits(rule: Rule, a: str, b: str):
    return (100 * F.col(a) >= rule.percent * F.col(b)) & (100 * F.col(b) >= rule.percent * F.col(a))


def _meets(rule: Rule):
    """Whether a list may be the first that two sets share: what stands before it in either is what that set has alone."""
    overlap = F.floor((rule.percent * (F.col("n") + F.col("pn")) + 99 + rule.percent) / (100 + rule.percent))
    return _fits(rule, "n", "pn") & (F.col("pos") <= F.col("n") - overlap) & (F.col("ppos") <= F.col("pn") - overlap)


def _met(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Join on token, and further keys, of rows with `members`, the rows a token has in all. The lists of one with many are dealt to several tasks: each row of the left to one, those of the right to all."""
    parts = F.ceil(F.col("members") / SHARE).cast("int")
    left = left.withColumn("share", F.pmod(F.xxhash64("u"), parts).cast("int")).drop("members")
    return left.join(right.withColumn("share", F.explode(F.sequence(F.lit(0), parts - 1))).drop("members"), ["token", "share", *keys])


def _links(sets: DataFrame, docs: DataFrame, rule: Rule, n: int) -> DataFrame:
    """Stars (u, v) of the components of the classes. sets: one row a class."""
    spark = docs.sparkSession
    light = sets.select("n", F.col("doc_id").alias("id"), F.explode("subsets").alias("subset"))
    light_stars = _stars(light, "subset", ["n", "id"]).where(_fits(rule, "n", "pn")).select("u", F.col("id").alias("v"))

    total = sets.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    posted = sets.select("n", F.col("doc_id").alias("id"), F.posexplode("tokens").alias("pos", "token"))
    repeated = spark.sparkContext.broadcast(bloom.repeated_filter(posted.select("token"), total, 10))

    @F.pandas_udf("boolean")
    def maybe(s: pd.Series) -> pd.Series:
        return pd.Series(repeated.value.maybe(s.to_numpy()))

    posted = materialize(posted.where(maybe("token")), "postings")
    repeated.destroy()
    shared = posted.groupBy("token").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    lists = materialize(lookup(posted, "token", materialize(shared, "lists"), max(1, posted.count())).where("members is not null"), "shared")
    # A pivot that meets many others is likely the original of its copies: members of its lists, all told.
    degree = materialize(lists.groupBy("id").agg(F.sum("members").alias("degree")), "degrees")
    ranked = materialize(lists.join(degree, "id").select("token", "id", "n", "pos", "degree"), "ranked")
    release(posted, lists, degree)
    lists = ranked

    order, most = [(-F.col("degree")).alias("d")], 1 - rule.percent / 100 + 1e-9
    links, pivots = None, 1
    while True:
        stars = materialize(_stars(lists, "token", order, pivots), "stars")
        pairs = stars.where(_fits(rule, "n", "pn")).select("u", F.col("id").alias("v"))
        seen = _verified(pairs if links is not None else pairs.unionByName(light_stars), docs, rule, n)
        linked = seen.where("linked").select("u", "v")
        links = materialize(linked if links is None else links.unionByName(linked), "links")
        # Lists of three or more go on. A pair too unlike in size was not compared: its distance is at least that of the sizes. Pivots are done with: they have met all members.
        rows = stars.where("members > 2 and not pivot").join(seen.select("u", F.col("v").alias("id"), "d", "linked"), ["u", "id"], "left")
        apart = 1 - F.least("n", "pn") / F.greatest("n", "pn")
        rows = materialize(rows.select("token", "members", "id", "n", "pos", "degree", "u", F.coalesce("d", apart).alias("d"), F.coalesce("linked", F.lit(False)).alias("linked")), "compared")
        border = rows.where(~F.col("linked") & (F.col("d") <= 2 * most))
        labels = components(links) if border.limit(1).count() else None
        close = None
        if labels is not None:
            name = labels.select("u", F.col("v").alias("label"))
            border = border.join(name.withColumnRenamed("u", "id").withColumnRenamed("label", "mine"), "id", "left").join(name, "u", "left")
            border = materialize(border.where(F.coalesce("mine", "id") != F.coalesce("label", "u")).select("token", "members", F.col("u").alias("star"), F.col("id").alias("u"), F.col("n").alias("pn"), F.col("pos").alias("ppos"), F.col("d").alias("dx")), "border")
            near = rows.where("linked").select("token", "members", F.col("u").alias("star"), F.col("id").alias("v"), "n", "pos", "d")
            if pivots > 1:  # a member is held against the border of its nearest pivot
                near = near.groupBy("token", "v").agg(F.min(F.struct("d", "star", "members", "n", "pos")).alias("x")).select("token", "v", "x.*")
            close = _met(border, near, "star").where((F.col("d") >= F.col("dx") - most) & _meets(rule)).select("u", "v")
        if pivots > 1:
            far = rows.groupBy("token", "id").agg(F.max("linked").alias("linked"), *(F.first(c).alias(c) for c in ("n", "pos", "degree"))).where("not linked")
        else:
            far = rows.where("not linked")
        left = materialize(far.groupBy("token").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "left")
        postings, few = left.agg(F.coalesce(F.sum("members"), F.lit(0)), F.coalesce(F.sum(F.col("members") * (F.col("members") - 1) / 2), F.lit(0.0))).first()
        lists = materialize(lookup(far.select("token", "id", "n", "pos", "degree"), "token", left, max(1, rows.count())).where("members is not null"), "far")
        release(stars, seen, left)
        if few <= max(4 * postings, total):
            break
        if close is not None:
            links = materialize(links.unionByName(_verified(close, docs, rule, n).where("linked").select("u", "v")), "links")
        lists, pivots = lists.drop("members"), min(4 * pivots, PIVOTS)
    rest = _met(lists.select("token", "members", F.col("id").alias("u"), F.col("n").alias("pn"), F.col("pos").alias("ppos")), lists.select("token", "members", F.col("id").alias("v"), "n", "pos"))
    rest = rest.where("u < v").where(_meets(rule)).select("u", "v")
    last = _verified(rest if close is None else rest.unionByName(close), docs, rule, n)
    return components(links.unionByName(last.where("linked").select("u", "v")))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 90, n: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    rule = Rule(percent)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = _sets(docs, rule, n)
    full = sets.where("n > 0 and doc_id is not null")
    same = materialize(full.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("members")), "same")
    # One row of each class: that of its smallest doc_id. (key, doc_id) is no hot key, and repeated rows are one.
    chosen = full.join(same.select("key", F.col("first").alias("doc_id")), ["key", "doc_id"], "left_semi").dropDuplicates(["key", "doc_id"])
    labels = _links(materialize(chosen, "chosen"), docs, rule, n)
    named = same.join(labels.select(F.col("u").alias("first"), F.col("v").alias("least")), "first", "left")
    named = materialize(named.select("key", "members", F.coalesce("least", "first").alias("component_id")), "named")
    met = lookup(full.select("key", "doc_id", "n"), "key", named, max(1, full.count())).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    alone = sets.where("n = 0 or doc_id is null").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return met.unionByName(alone)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 90, n: int = 3) -> DataFrame:
    """docs with one document of each component: that with the smallest id. The ids to leave out pass as a Bloom filter, so only rows that it may name shuffle."""
    spark = docs.sparkSession
    gone = materialize(classes(docs, id_col, text_col, percent, n).where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    named = spark.sparkContext.broadcast(bloom.repeated_filter(gone.select(F.explode(F.array_repeat(F.xxhash64("doc_id"), 2))), 2 * gone.count()))

    @F.pandas_udf("boolean")
    def maybe(s: pd.Series) -> pd.Series:
        return pd.Series(named.value.maybe(s.to_numpy()))

    rows = enclosed(docs).withColumn("id", F.col(ROW)[id_col].cast("long"))
    rows = rows.withColumn("maybe", maybe(F.xxhash64("id")) & F.col("id").isNotNull())
    kept = rows.where("maybe").join(gone.select(F.col("doc_id").alias("gone")), F.col("id") == F.col("gone"), "left_anti")
    return released(rows.where("not maybe").unionByName(kept))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
