"""Quality rules: log-likelihood ratio of hashed n-grams between a trusted target and the raw corpus.

The n-grams are the single words and the pairs of neighbouring words, whole, hashed into `buckets`. Both multinomials are
counted over whole texts: the corpus over all documents, the target over the documents whose ids are given (a bounded
sample of the labelled ones). A document's score is the mean log ratio of its n-grams; it is kept at or above a fixed
threshold, and never if a base rule fails. Spark expressions only.

Defined cases: a null or empty text has no words, so its score is 0 and the base rule fails. A very long text is one row
of arrays in proportion to its words. Repeated rows count as often as they come. Columns with the names of the result's
(n_words, ..., kept) are replaced, others stay, whatever their names. An empty table gives an empty result; an empty
target gives score 0 to all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import ROW, enclosed, table, word_array

MAX_TARGET = 16_000  # bound of the trusted sample: labelled rows in the order of a hash


def hashed_words(df: DataFrame, words: str) -> DataFrame:
    """df with `w1`, the hash of each word, and `w2`, that of the pair that begins at each; the last pair is cut short.

    Each step is a column of its own: an array that one expression names twice would be computed twice."""
    df = df.withColumn("w1", F.transform(words, lambda w: F.xxhash64(w)))
    return df.withColumn("w2", _wider("w1", 1))


def _wider(name: str, k: int) -> Column:
    """Hashes of runs of 2k words from those of k. zip_with fills up with nulls, so the last runs are cut short."""
    h = F.col(name)
    return F.zip_with(h, F.slice(h, F.lit(k + 1), F.greatest(F.size(h) - k, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def _grams() -> Column:
    """The hashes of the n-grams; a bucket are the lowest bits, so the number of buckets is a power of two."""
    return F.concat("w1", F.slice("w2", F.lit(1), F.greatest(F.size("w1") - 1, F.lit(0))))


def _bucket(gram: Column, buckets: int) -> Column:
    return gram.bitwiseAND(F.lit(buckets - 1).cast("long")).cast("int")


def log_ratios(docs: DataFrame, target_ids: DataFrame, id_col: str, text_col: str, buckets: int, alpha: float) -> DataFrame:
    """One row, `weights`: the log ratio of each bucket. target_ids: at most MAX_TARGET rows, so it is broadcast.

    Each bucket gets alpha target n-grams more, and as many corpus n-grams more as keep their ratio at one."""
    rows = docs.select(F.col(id_col).alias("id"), word_array(F.col(text_col)).alias("words"))
    marked = rows.join(F.broadcast(target_ids.limit(MAX_TARGET).select(F.col("doc_id").alias("target")).distinct()), F.col("id") == F.col("target"), "left")
    marked = hashed_words(marked.select(F.col("target").isNotNull().cast("long").alias("t"), "words"), "words")
    # The buckets are taken inside explode: for a bare column Spark infers a filter on its size, which computes all of it again.
    grams = marked.select("t", F.explode(F.transform(_grams(), lambda g: _bucket(g, buckets))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("c"))
    all_ = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0, ["t", "c"])
    row = all_.agg(F.array_sort(F.collect_list(F.struct("bucket", "t", "c"))).alias("m"), F.sum("t").alias("nt"), F.sum("c").alias("nc"))
    share = F.greatest(F.col("nt"), F.lit(1)) / F.greatest(F.col("nc"), F.lit(1))
    ratio = lambda x: F.log((x["t"] + alpha) / (x["c"] * F.col("share") + alpha))
    return row.withColumn("share", share).select(F.when(F.col("nt") > 0, F.transform("m", ratio)).otherwise(F.array_repeat(F.lit(0.0), buckets)).alias("weights"))


def window_hashes(df: DataFrame, window: int = 8) -> DataFrame:
    """df with `windows`: the 64-bit hash of the window of `window` words (a power of two, 4 at least) that begins at each word. It has w1 and w2.

    Windows double in width. Where no window of half the width repeats, none of the full width does, and the array is empty."""
    k, n = 2, F.size("w1")
    while 2 * k < window:
        df, k = df.withColumn(f"w{2 * k}", _wider(f"w{k}", k)), 2 * k
    whole = F.slice(f"w{k}", F.lit(1), F.greatest(n - (k - 1), F.lit(0)))
    wider = F.slice(_wider(f"w{k}", k), F.lit(1), F.greatest(n - (window - 1), F.lit(0)))
    return df.withColumn("windows", F.when(F.size(F.array_distinct(whole)) < F.size(whole), wider).otherwise(F.array().cast("array<bigint>")))


def covered(windows: Column, window: int = 8) -> Column:
    """Number of words that the repeated windows cover, given the hash of the window at each word."""
    by_hash = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.slice(by_hash["h"], F.lit(1), F.size(by_hash) - 1))
    after = F.concat(F.slice(by_hash["h"], F.lit(2), F.size(by_hash) - 1), F.array(F.lit(None).cast("bigint")))
    trios = F.arrays_zip(by_hash.alias("x"), before.alias("p"), after.alias("q"))
    hit = F.filter(trios, lambda t: t["x"]["h"].eqNullSafe(t["p"]) | t["x"]["h"].eqNullSafe(t["q"]))
    at = F.array_sort(F.transform(hit, lambda t: t["x"]["i"]))
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("end"))
    return F.aggregate(at, start, lambda s, i: F.struct((s["words"] + window - F.greatest(s["end"] - i, F.lit(0))).alias("words"), (i + window).alias("end")), lambda s: s["words"])


def base_features(df: DataFrame, text: Column) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the arrays words, w1, w2 and windows."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = window_hashes(hashed_words(df.withColumn("words", word_array(text)), "words"))
    repeats = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), covered(F.col("windows"))).otherwise(0)
    return df.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.char_length(F.array_join("words", "")).cast("long"),
        "n_symbols": F.when(text.rlike("[#*$%&|<>]"), F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).otherwise(0).cast("long"),
        "n_dup_lines": F.when(text.contains("\n"), F.size(lines) - F.size(F.array_distinct(lines))).otherwise(0).cast("long"),
        "n_repeat_words": repeats.cast("long"),
    })


FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]


def judge(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1 << 16, alpha: float = 4.0, threshold: float = -0.1) -> DataFrame:
    """docs with the base features, base_failed, score (mean log ratio) and kept."""
    weights = log_ratios(docs.select(id_col, text_col), target_ids, id_col, text_col, buckets, alpha)
    df = base_features(enclosed(docs.drop(*FEATURES)), F.col(ROW)[text_col])
    df = df.withColumn("weights", weights.scalar())  # one row of `buckets` doubles
    total = F.aggregate(_grams(), F.lit(0.0), lambda s, g: s + F.get(F.col("weights"), _bucket(g, buckets)))
    df = df.withColumn("score", F.when(F.col("n_words") > 0, total / (2 * F.col("n_words") - 1)).otherwise(0.0))
    df = df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)).select(f"{ROW}.*", *FEATURES)


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids labelled as good, MAX_TARGET at most, in the order of a hash of the id."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").where("doc_id is not null")
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TARGET)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge(docs, trusted_ids(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score"))
