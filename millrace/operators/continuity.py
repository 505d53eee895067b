"""What stays the same between runs and groups: clusters of two runs matched one to one, questions matched to clusters,
shapes of clusters, divergence of groups, and the sanity of merges. Tables of clusters and threads are a row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.vectors import cosine_distance, cosine_distance_literal
from millrace.operators.rounds import written


def similar(old: DataFrame, new: DataFrame, least: float, label: str = "label", centroid: str = "centroid") -> DataFrame:
    """(old, new, similarity) of centroids that are near enough. old: a few hundred rows, one array a task."""
    table = old.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), F.col(centroid).cast("array<double>").alias("c")))).alias("t"))
    near = F.transform("__t", lambda o: F.struct(o["label"].alias("old"), F.round(1 - cosine_distance(F.col(centroid).cast("array<double>"), o["c"]), 9).alias("similarity")))
    pairs = new.withColumn("__t", table.scalar()).select(F.col(label).alias("new"), F.explode(F.filter(near, lambda p: p["similarity"] >= least)).alias("p"))
    return pairs.select("p.old", "new", "p.similarity")


def matched(pairs: DataFrame) -> DataFrame:
    """One-to-one matching, the most similar first: pairs that are each other's best are taken, and those left compete again. Ties by the smaller labels."""
    left, taken = written(pairs, "pairs"), []
    while not left.isEmpty():
        best = lambda side: F.row_number().over(Window.partitionBy(side).orderBy(F.desc("similarity"), "old", "new"))
        mutual = written(left.withColumns({"a": best("old"), "b": best("new")}).where("a = 1 and b = 1").select("old", "new", "similarity"), "mutual")
        taken.append(mutual)
        left = written(left.join(mutual.select("old"), "old", "left_anti").join(mutual.select("new"), "new", "left_anti"), "pairs")
    out = taken[0] if taken else left
    for more in taken[1:]:
        out = out.unionByName(more)
    return out


def continuity(old: DataFrame, new: DataFrame, least: float = 0.8, label: str = "label", centroid: str = "centroid") -> DataFrame:
    """(old, new, similarity, fate) of the clusters of two runs: `kept` pairs; `split`, a new one whose nearest old one was kept by another; `merged`, an old one whose nearest new one was; `born` and `gone`, without any near enough."""
    pairs = written(similar(old, new, least, label, centroid), "similar")
    kept = written(matched(pairs), "kept").withColumn("fate", F.lit("kept"))

    def alone(rows: DataFrame, side: str, other: str, fate: str, without: str) -> DataFrame:
        rest = rows.select(F.col(label).alias(side)).join(kept.select(side), side, "left_anti")
        best = pairs.groupBy(side).agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col(other).alias("o"))).alias("b"))
        return rest.join(best, side, "left").select(side, F.col("b.o").alias(other), (-F.col("b.s")).alias("similarity"), F.when(F.col("b").isNull(), without).otherwise(fate).alias("fate")).select("old", "new", "similarity", "fate")

    return kept.unionByName(alone(new, "new", "old", "split", "born")).unionByName(alone(old, "old", "new", "merged", "gone"))


def carried(new: DataFrame, fates: DataFrame, label: str = "label") -> DataFrame:
    """new with `stable`, the label that it keeps from the run before, or its own beyond all old ones."""
    last = fates.agg(F.coalesce(F.max("old"), F.lit(-1)).alias("m"))
    names = fates.where("fate = 'kept'").select(F.col("new").alias(label), "old")
    return new.join(names, label, "left").withColumn("stable", F.coalesce(F.col("old"), last.scalar() + 1 + F.col(label))).drop("old")


def question_clusters(centers: DataFrame, vector: list[float], hits: DataFrame, most: int = 8, meaning: float = 0.7, weak: float = 0.5, label: str = "label", centroid: str = "centroid") -> DataFrame:
    """Clusters for a question, by a blend of the nearness of their centroids and their share of full-text hits (label, hits), logarithms of both counts.

    `margin` is how far the next cluster stands behind; `weak` marks an answer whose best score is below the bar: then the corpus hardly holds the question."""
    near = 1 - cosine_distance_literal(F.col(centroid).cast("array<double>"), vector)
    rows = centers.join(hits, label, "left").select(label, F.round(near, 9).alias("similarity"), F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))
    share = F.coalesce(F.try_divide(F.log1p("hits"), F.log1p(F.max("hits").over(Window.partitionBy()))), F.lit(0.0))  # a row a cluster
    scored = rows.withColumn("score", F.round(meaning * F.greatest(F.col("similarity"), F.lit(0.0)) + (1 - meaning) * share, 9))
    order = Window.orderBy(F.desc("score"), label)
    ranked = scored.withColumns({"rank": F.row_number().over(order), "margin": F.round(F.col("score") - F.lead("score").over(order), 9), "weak": F.first("score").over(order) < weak})
    return ranked.where(F.col("rank") <= most)


def shape_tags(geometry: DataFrame) -> DataFrame:
    """geometry (label, n, weeks, span_weeks, burstiness, drift, directionality) with `shape`, from each measure's place among all clusters."""
    place = lambda c: F.percent_rank().over(Window.orderBy(c))  # noqa: E731  a row a cluster
    rows = geometry.withColumns({f"__{c}": place(c) for c in ("burstiness", "drift", "directionality")})
    steady = F.col("weeks") >= 0.8 * F.col("span_weeks")
    shape = (
        F.when(F.col("weeks") <= 1, "brief mention").when(F.col("__burstiness") >= 0.8, "spike and decay").when((F.col("__drift") >= 0.5) & (F.col("__directionality") >= 0.75), "directional")
        .when((F.col("__drift") >= 0.5) & (F.col("__directionality") < 0.25), "churn").when(steady & (F.col("__burstiness") <= 0.5), "heartbeat").otherwise("topical thread")
    )
    return rows.withColumn("shape", shape).drop("__burstiness", "__drift", "__directionality")


def divergence(counts: DataFrame, group: str, item: str, period: str, n: str = "n") -> DataFrame:
    """Jensen-Shannon divergence, in bits, of each group's items in a period from those of all other groups together; and how many of the peers' items it lacks, and has alone. Null where it has no peers."""
    own, all_, total = Window.partitionBy(period, group), Window.partitionBy(period, item), Window.partitionBy(period)
    groups = counts.select(period, group).distinct()
    items = counts.select(period, item).distinct()
    full = groups.join(items, period).join(counts.groupBy(period, group, item).agg(F.sum(n).alias("n")), [period, group, item], "left").fillna(0, ["n"])
    rows = full.withColumns({"own": F.sum("n").over(own), "item_all": F.sum("n").over(all_), "period_all": F.sum("n").over(total)})
    p, q = F.try_divide("n", "own"), F.try_divide(F.col("item_all") - F.col("n"), F.col("period_all") - F.col("own"))
    rows = rows.withColumns({"p": p, "q": q}).withColumn("m", (F.col("p") + F.col("q")) / 2)
    term = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / F.col("m"))).otherwise(F.when(F.col("q").isNotNull(), 0.0))
    return rows.groupBy(period, group).agg(F.sum(F.when(F.col("q").isNotNull(), (term("p") + term("q")) / 2)).alias("divergence"), F.count_if((F.col("n") == 0) & (F.col("q") > 0)).alias("lacks"), F.count_if((F.col("n") > 0) & (F.col("q") == 0)).alias("alone"))


def merge_cycles(edges: DataFrame, source: str = "from_thread", target: str = "to_thread") -> DataFrame:
    """Threads on a cycle of merges. A thread merges into one (of several, the smallest); pointers double their reach, so rounds are few even for long chains."""
    step = written(edges.groupBy(F.col(source).alias("x")).agg(F.min(target).alias("y")), "merges")
    reach, hops, most = step, 1, step.count()
    while hops < most:
        over = reach.select(F.col("x").alias("y"), F.col("y").alias("z"))
        reach = written(reach.join(over, "y").select("x", F.col("z").alias("y")), "reach")
        hops *= 2
    return reach.select(F.col("y").alias("thread")).distinct()


def merge_audit(edges: DataFrame, beats: DataFrame, days: int = 60) -> DataFrame:
    """(from_thread, to_thread, flag) of merges that can't be right: into themselves or round a cycle, of or into a thread without beats (orphans), more than one merge of a thread, and a surviving thread without a beat within `days` of the merge.

    edges: from_thread, to_thread, at_date; beats: thread, day."""
    keys = ["from_thread", "to_thread"]
    cyclic = merge_cycles(edges).withColumnRenamed("thread", "from_thread")
    known = beats.select("thread").distinct()
    flag = lambda df, name: df.select(*keys, F.lit(name).alias("flag"))
    orphans = edges.join(known.withColumnRenamed("thread", "from_thread"), "from_thread", "left_anti").unionByName(edges.join(known.withColumnRenamed("thread", "to_thread"), "to_thread", "left_anti"), allowMissingColumns=True)
    twice = edges.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("from_thread"))).where("__n > 1")
    # Days are cut to periods, so that the range is an equality on neighbouring periods.
    period = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / days)
    near = edges.withColumn("__p", F.explode(F.array(*(period(F.col("at_date")) + i for i in (-1, 0, 1))))).join(
        beats.select(F.col("thread").alias("to_thread"), F.col("day").alias("__day"), period(F.col("day")).alias("__p")).distinct(), ["to_thread", "__p"]
    )
    lively = near.where(F.abs(F.datediff("__day", "at_date")) <= days).select(*keys, "at_date").distinct()
    quiet = edges.where("at_date is not null").join(lively, [*keys, "at_date"], "left_anti")
    return flag(edges.join(cyclic, "from_thread"), "cycle").unionByName(flag(orphans, "orphan")).unionByName(flag(twice, "merged twice")).unionByName(flag(quiet, "survivor quiet")).distinct()


def explosion(beats: DataFrame, group: str, meeting: str, limit: float = 3.0) -> DataFrame:
    """Meetings with more new threads than `limit` times their group's mean: the bar for a new thread is too low. beats: thread, day, group, meeting."""
    first = beats.groupBy("thread", group).agg(F.min(F.struct("day", meeting)).alias("f")).select(group, F.col(f"f.{meeting}").alias(meeting))
    counts = first.groupBy(group, meeting).agg(F.count(F.lit(1)).alias("started"))
    return counts.withColumn("mean", F.avg("started").over(Window.partitionBy(group))).where(F.col("started") > limit * F.col("mean"))


def single_beats(beats: DataFrame, group: str) -> DataFrame:
    """Share of each group's threads that have a single beat: with too strict a match nothing attaches."""
    sizes = beats.groupBy(group, "thread").agg(F.count(F.lit(1)).alias("n"))
    one: Column = F.count_if(F.col("n") == 1)
    return sizes.groupBy(group).agg(F.count(F.lit(1)).alias("threads"), one.alias("single"), (one / F.count(F.lit(1))).alias("share"))
