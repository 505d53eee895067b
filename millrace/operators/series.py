"""Series of clusters over time: weekly aggregates, burstiness, distinctive terms, semantic drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import school_year, week_start
from millrace.functions.vectors import capped_ratio, cosine_distance
from millrace.operators.rounds import indexed

# The stop list of distinctive terms.
STOPWORDS = (
    "the and for that with was his this have are not but from they her she him has had who which were been their there will would all one two when "
    "what then them out our your you can could should may might must shall upon said say says very more most much many some any each every other "
    "into over under after before about above between both same such only also being its these those does did done because where while against "
    "during without within through however therefore thus hence yet still nor own too here now even ever never again once just like well make made "
    "take taken give given get got see seen know known come came went gone way day days man men mrs miss esq inst ult new old"
).split()


def binned(day: Column, unit: str = "week") -> Column:
    """Start of the ISO week, the month, or the school year as text: sparse dates want wider bins."""
    return {"week": week_start(day).cast("string"), "month": F.date_format(day, "yyyy-MM"), "school_year": school_year(day)}[unit]


def weekly(members: DataFrame, cluster: str = "cluster", day: str = "day", paper: str = "paper") -> DataFrame:
    """Per cluster and week: number of members, members by paper, mean quality without nulls, mean place."""
    week = members.withColumn("week_start", week_start(F.col(day)))
    by_paper = week.groupBy(cluster, "week_start", paper).agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("q"), F.count("quality").alias("nq"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    return by_paper.groupBy(cluster, "week_start").agg(
        F.sum("n").alias("members"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(paper, "n")))).alias("by_paper"),  # one entry a paper
        (F.sum("q") / F.nullif(F.sum("nq"), F.lit(0))).alias("mean_quality"),
        (F.sum("sx") / F.sum("n")).alias("x"),
        (F.sum("sy") / F.sum("n")).alias("y"),
    )


def burstiness(members: DataFrame, cluster: str = "cluster", day: str = "day") -> DataFrame:
    """Population coefficient of variation of the weekly counts; weeks without members don't count."""
    weeks = members.groupBy(cluster, week_start(F.col(day)).alias("week_start")).agg(F.count(F.lit(1)).alias("n"))
    return weeks.groupBy(cluster).agg(F.coalesce(F.stddev_pop("n") / F.nullif(F.avg("n"), F.lit(0.0)), F.lit(0.0)).alias("burstiness"), F.count(F.lit(1)).alias("n_weeks"), F.sum("n").alias("members"))


def distinctive_terms(members: DataFrame, cluster: str = "cluster", day: str = "day", text: str = "text", most: int = 5, least_count: int = 2) -> DataFrame:
    """Top terms of each cluster and week: count * ln(1 + mean tokens a week / count in the cluster); ties put the later term first.

    Terms are counted before anything is gathered, so a frequent one never meets in one task."""
    week = members.select(cluster, week_start(F.col(day)).alias("week_start"), F.col(text).alias("__text"))
    tokens = F.filter(F.regexp_extract_all(F.lower(F.coalesce("__text", F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0)), lambda t: ~t.isin(STOPWORDS))
    counts = week.select(cluster, "week_start", F.explode(tokens).alias("term")).groupBy(cluster, "week_start", "term").agg(F.count(F.lit(1)).alias("n"))
    in_cluster = counts.groupBy(cluster, "term").agg(F.sum("n").alias("f"))
    n_weeks = week.groupBy(cluster).agg(F.count_distinct("week_start").alias("weeks"))
    mean = counts.groupBy(cluster).agg(F.sum("n").alias("tokens")).join(n_weeks, cluster).select(cluster, (F.col("tokens") / F.col("weeks")).alias("mean"))
    scored = counts.where(F.col("n") >= least_count).join(in_cluster, [cluster, "term"]).join(mean, cluster)
    scored = scored.withColumn("score", F.round(F.col("n") * F.log1p(F.col("mean") / F.col("f")), 9))
    place = Window.partitionBy(cluster, "week_start").orderBy(F.desc("score"), F.desc("term"))
    return scored.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most).select(cluster, "week_start", "place", "term", "n", "score")


def weekly_centroids(members: DataFrame, cluster: str = "cluster", day: str = "day", embedding: str = "embedding") -> DataFrame:
    """Mean vector of each cluster and week, summed a dimension at a time."""
    rows = members.where(F.col(embedding).isNotNull()).select(cluster, week_start(F.col(day)).alias("week_start"), F.posexplode(embedding).alias("i", "v"))
    mean = rows.groupBy(cluster, "week_start", "i").agg(F.avg(F.col("v").cast("double")).alias("v"), F.count(F.lit(1)).alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"])  # one entry a dimension
    return mean.groupBy(cluster, "week_start").agg(ordered.alias("centroid"), F.max("n").alias("n"))


def drift(centroids: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Path length (sum of cosine distances of successive weeks), net distance first to last, and their capped ratio."""
    w = Window.partitionBy(cluster).orderBy("week_start")
    steps = centroids.withColumn("before", F.lag("centroid").over(w)).withColumn("step", F.when(F.col("before").isNotNull(), cosine_distance(F.col("before"), F.col("centroid"))))
    out = steps.groupBy(cluster).agg(
        F.coalesce(F.sum("step"), F.lit(0.0)).alias("path"), F.min_by("centroid", "week_start").alias("a"), F.max_by("centroid", "week_start").alias("b"),
        F.count(F.lit(1)).alias("n_weeks"), F.sum("n").alias("members"),
    )
    out = out.withColumn("net", cosine_distance(F.col("a"), F.col("b"))).drop("a", "b")
    return out.withColumn("ratio", capped_ratio(F.col("net"), F.col("path")))


def strongest_drift(drifts: DataFrame, by: str = "net", most: int = 15, least_members: int = 30, cluster: str = "cluster") -> DataFrame:
    return drifts.where(F.col("members") >= least_members).orderBy(F.col(by).desc_nulls_last(), cluster).limit(most)


def seasonal_score(counts: DataFrame, keys: list[str], period: str, year: str, n: str = "n") -> DataFrame:
    """z-score of each period against the same period of earlier years; null without two of them."""
    w = Window.partitionBy(*keys, period).orderBy(year).rowsBetween(Window.unboundedPreceding, -1)
    spread = F.stddev_samp(n).over(w)
    return counts.withColumn("z", F.when(spread > 0, F.try_divide(F.col(n) - F.avg(n).over(w), spread)))


def shares(counts: DataFrame, group: str, n: str = "n") -> DataFrame:
    """counts as shares of their group's total, so that groups of different size compare."""
    return counts.withColumn("share", F.col(n) / F.sum(n).over(Window.partitionBy(group)))


def moving_centroid(members: DataFrame, thread: str, order: str, embedding: str, weight: float = 0.3) -> DataFrame:
    """Exponential moving mean of a thread's vectors in order, beside its first vector and the distance between both.

    The mean is a sum with weights that fall with the distance from the end, so it is added up dimension by dimension, and no thread is gathered or ordered in one task. Rows without a vector or thread take no part; order tells a thread's rows apart."""
    rows = members.where(F.col(embedding).isNotNull() & F.col(thread).isNotNull()).select(thread, order, F.col(embedding).cast("array<double>").alias("__v"))
    placed = indexed(rows, [thread], [order], "threads")
    share = F.when(F.col("idx") == 0, 1.0).otherwise(weight) * F.pow(F.lit(1 - weight), F.col("size") - 1 - F.col("idx"))
    each = placed.select(thread, "idx", share.alias("share"), F.posexplode("__v").alias("i", "x"))
    sums = each.groupBy(thread, "i").agg(F.sum(F.col("share") * F.col("x")).alias("ema"), F.max(F.when(F.col("idx") == 0, F.col("x"))).alias("first"))
    whole = sums.groupBy(thread).agg(F.array_sort(F.collect_list(F.struct("i", "first", "ema"))).alias("d"))  # a vector's dimensions
    return whole.select(thread, F.col("d.first").alias("first"), F.col("d.ema").alias("ema")).withColumn("drift", cosine_distance(F.col("first"), F.col("ema")))
