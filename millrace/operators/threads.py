"""Threads of events over time: assignment by identifier or nearness, edges with evidence, and audits of their order.

Designs without a reference implementation; events never join a thread of another group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.vectors import cosine_distance


def jaccard(a: Column, b: Column) -> Column:
    """Share of common entries of two arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.try_divide(F.size(F.array_intersect(a, b)), union)).otherwise(0.0)


def anchored(events: DataFrame, threads: DataFrame) -> DataFrame:
    """Events whose identifier names a thread of their group."""
    return events.join(threads.select("grp", "identifier", "thread"), ["grp", "identifier"])


def shortlist(events: DataFrame, threads: DataFrame, days: int, most: int = 3, least: float = 0.0) -> DataFrame:
    """Up to `most` threads of each event's group that were active within `days` before it, by nearness of centroid and entities.

    events: id, grp, day, embedding, entities; threads: grp, thread, last_day, centroid, entities. Both sides are cut to
    periods of `days`, so the range becomes an equality on two neighbouring periods. Nearness depends on the profile alone:
    of threads that share group, day, centroid and entities only the first `most` can be listed, and events of one profile
    share their list. So profiles meet, not rows, and rows take their profile's list."""
    period = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / days)
    alike = Window.partitionBy("grp", "last_day", "centroid", "entities").orderBy("thread")
    first = threads.select("grp", "thread", "last_day", "centroid", "entities").withColumn("__n", F.row_number().over(alike)).where(F.col("__n") <= most)
    b = first.select("grp", "thread", "last_day", "centroid", F.col("entities").alias("known"), F.explode(F.array(period(F.col("last_day")), period(F.col("last_day")) + 1)).alias("period"))
    a = events.select("grp", "day", "embedding", "entities").distinct().withColumn("period", period(F.col("day")))
    met = a.join(b, ["grp", "period"]).where((F.col("last_day") <= F.col("day")) & (F.datediff("day", "last_day") <= days))
    score = 0.5 * (1 - cosine_distance(F.col("embedding"), F.col("centroid"))) + 0.5 * jaccard(F.col("entities"), F.col("known"))
    best = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("score"), "thread")
    scored = met.withColumn("score", F.round(score, 9)).where(F.col("score") >= least)
    lists = scored.withColumn("__n", F.row_number().over(best("grp", "day", "embedding", "entities"))).where(F.col("__n") <= most)
    lists = lists.select("grp", "day", "embedding", F.col("entities").alias("__of"), "thread", "score")
    listed = events.join(lists, ["grp", "day", "embedding"]).where(F.col("entities").eqNullSafe(F.col("__of")))
    return listed.withColumn("place", F.row_number().over(best("id"))).where(F.col("place") <= most).select("id", "grp", "thread", "score", "place")


def edges_without_evidence(edges: DataFrame) -> DataFrame:
    """Forks, merges and replacements that cite nothing: they don't stand."""
    return edges.where(F.col("kind").isin("fork", "merge", "superseded") & (F.coalesce(F.size("evidence"), F.lit(0)) <= 0))


def out_of_order(events: DataFrame, lifecycle: list[str]) -> DataFrame:
    """Events of a thread at an earlier stage of the lifecycle than the event before."""
    stage = F.array_position(F.lit(lifecycle), F.col("stage"))
    w = Window.partitionBy("thread").orderBy("day", "id")
    return events.withColumn("__s", stage).withColumn("__b", F.lag("__s").over(w)).where("__s < __b").drop("__s", "__b")


def quiet(events: DataFrame, today: Column, days: int) -> DataFrame:
    """Open threads without an event for so many days."""
    last = events.groupBy("thread").agg(F.max("day").alias("last_day"), F.max_by("stage", F.struct("day", "id")).alias("stage"))
    return last.where((F.col("stage") != "closed") & (F.datediff(today, "last_day") > days))


def coverage(claims: DataFrame, group: str) -> DataFrame:
    """Share of claims with evidence."""
    has = F.coalesce(F.size("evidence"), F.lit(0)) > 0
    return claims.groupBy(group).agg(F.count_if(has).alias("covered"), F.count(F.lit(1)).alias("claims"), (F.count_if(has) / F.count(F.lit(1))).alias("coverage"))


def beat_candidates(chunks: DataFrame, kinds: list[str], key: str, day: str = "day", done: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Chunks of the given kinds in the order of time, undated last, without those whose events are drawn already: what an event extractor reads next."""
    rows = chunks.where(F.col("doc_type").isin(kinds))
    if done is not None:
        rows = rows.join(done.select(key).distinct(), key, "left_anti")
    ordered = rows.orderBy(F.col(day).asc_nulls_last(), key)
    return ordered if most is None else ordered.limit(most)
