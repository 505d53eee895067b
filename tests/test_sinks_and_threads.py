from __future__ import annotations

import datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from millrace.operators import continuity, threads
from millrace.sources import sinks


def test_runs_switch_at_once(spark, tmp_path):
    folder = str(tmp_path)
    sinks.write_run({"clusters": spark.range(3)}, folder, "r1")
    assert sinks.read_run(spark, folder, "clusters").count() == 3
    spark.range(9).write.parquet(f"{folder}/runs/r2/clusters")  # a run that broke off
    assert sinks.active_run(spark, folder) == "r1"
    sinks.write_run({"clusters": spark.range(5)}, folder, "r3")
    assert sinks.read_run(spark, folder, "clusters").count() == 5


def test_partitions_are_replaced(spark, tmp_path):
    folder = f"{tmp_path}/weeks"
    sinks.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "run int, x string"), folder, ["run"])
    sinks.replace_partitions(spark.createDataFrame([(2, "c"), (3, "d")], "run int, x string"), folder, ["run"])
    assert sorted((r.run, r.x) for r in spark.read.parquet(folder).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_the_last_snapshot_counts(spark, tmp_path):
    for n in (1, 2):
        sinks.publish(spark.range(1).select(F.array(F.lit(n)).alias("ids")), f"{tmp_path}/map")
    assert sinks.latest(spark, f"{tmp_path}/map")["ids"] == [2]


def test_reports_name_absent_groups(spark):
    ranking = spark.createDataFrame([("a|b", 1234.5)], "grp string, delta double")
    text = sinks.ranking_report("Slope", ranking, spark.createDataFrame([("c",)], "grp string"), "Values as printed.")
    assert "| a/b | 1,234.50 |" in text and "Not available: c." in text and text.endswith("Values as printed.")


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


def test_shortlist_stays_in_group_and_time(spark):
    events = spark.createDataFrame([(1, "g", day(40), [1.0, 0.0], ["x", "y"])], "id int, grp string, day date, embedding array<double>, entities array<string>")
    known = [("g", "t1", day(35), [1.0, 0.0], ["x"]), ("g", "t2", day(30), [0.0, 1.0], ["z"]), ("g", "late", day(41), [1.0, 0.0], ["x"]), ("g", "old", day(1), [1.0, 0.0], ["x"]), ("h", "other", day(39), [1.0, 0.0], ["x", "y"])]
    rows = threads.shortlist(events, spark.createDataFrame(known, "grp string, thread string, last_day date, centroid array<double>, entities array<string>"), 30).orderBy("place").collect()
    assert [(r.thread, r.score) for r in rows] == [("t1", 0.75), ("t2", 0.0)]


def test_shortlist_scores_profiles_not_rows(spark, monkeypatch):
    from pyspark.sql import types as T

    scored = spark.sparkContext.accumulator(0)

    @F.pandas_udf(T.DoubleType())
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        scored.add(len(a))
        return pd.Series([0.5] * len(a))

    monkeypatch.setattr(threads, "jaccard", counted)
    events = spark.createDataFrame([(i, "g", day(40), [1.0], ["x"] if i % 2 else None) for i in range(300)], "id int, grp string, day date, embedding array<double>, entities array<string>")
    known = spark.createDataFrame([("g", i, day(35 + i % 2), [1.0], ["x"]) for i in range(300)], "grp string, thread int, last_day date, centroid array<double>, entities array<string>")
    rows = threads.shortlist(events, known, 30).collect()
    assert sorted((r.id, r.thread, r.place) for r in rows) == [(i, p, p + 1) for i in range(300) for p in range(3)]
    assert scored.value < 100


def test_thread_audits(spark):
    events = spark.createDataFrame([(1, "t", day(0), "open"), (2, "t", day(1), "vote"), (3, "t", day(2), "open"), (4, "u", day(90), "closed")], "id int, thread string, day date, stage string")
    assert [r.id for r in threads.out_of_order(events, ["open", "vote", "closed"]).collect()] == [3]
    assert [r.thread for r in threads.quiet(events, F.lit(day(100)), 30).collect()] == ["t"]
    edges = spark.createDataFrame([("fork", ["e"]), ("merge", []), ("next", None), ("fork", None)], "kind string, evidence array<string>")
    assert threads.edges_without_evidence(edges).count() == 2
    assert threads.coverage(edges, "kind").where("kind = 'fork'").first().coverage == 0.5


def test_continuity_is_the_greedy_matching(spark):
    rng = np.random.default_rng(8)
    old = {i: rng.normal(size=4) for i in range(9)}
    new = {50 + i: old[i] + rng.normal(0, 0.5, 4) for i in (0, 1, 2, 3, 4)} | {60 + i: old[0] + rng.normal(0, 0.2, 4) for i in range(2)} | {70: -old[8]}
    cosine = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    near = sorted([(-cosine(a, b), i, j) for i, a in old.items() for j, b in new.items() if cosine(a, b) >= 0.6])
    pairs = {}
    for _, i, j in near:
        if i not in pairs and j not in pairs.values():
            pairs[i] = j
    frame = lambda rows: spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows.items()], "label int, centroid array<double>")
    fates = continuity.continuity(frame(old), frame(new), 0.6)
    got = fates.collect()
    assert {r.old: r.new for r in got if r.fate == "kept"} == pairs
    has = lambda side, k: any(k == n[side] for n in near)
    assert {r.new: r.fate for r in got if r.fate in ("split", "born")} == {j: "split" if has(2, j) else "born" for j in new if j not in pairs.values()}
    assert {r.old: r.fate for r in got if r.fate in ("merged", "gone")} == {i: "merged" if has(1, i) else "gone" for i in old if i not in pairs}
    stable = {r.label: r.stable for r in continuity.carried(frame(new), fates).collect()}
    assert len(set(stable.values())) == len(new) and all(stable[j] == i for i, j in pairs.items())
    assert {r.fate for r in continuity.continuity(frame(old), frame(new).limit(0), 0.6).collect()} == {"gone"}


def test_merge_audit_flags(spark):
    day = datetime.date(2024, 1, 1)
    edges = [(1, 2, day), (2, 3, day), (3, 1, day), (4, 1, day), (5, 5, day), (6, 7, day), (8, 9, day), (8, 1, day), (10, 9, None)]
    beats = [(i, day + datetime.timedelta(days=10)) for i in (1, 2, 3, 4, 5, 6, 8, 10)] + [(9, day + datetime.timedelta(days=200))]
    flags = continuity.merge_audit(spark.createDataFrame(edges, "from_thread int, to_thread int, at_date date"), spark.createDataFrame(beats, "thread int, day date"))
    assert {tuple(r) for r in flags.collect()} == {
        (1, 2, "cycle"), (2, 3, "cycle"), (3, 1, "cycle"), (5, 5, "cycle"), (6, 7, "orphan"), (6, 7, "survivor quiet"), (8, 9, "merged twice"), (8, 1, "merged twice"), (8, 9, "survivor quiet")
    }


def test_a_long_chain_of_merges_has_no_cycle(spark):
    edges = spark.range(300).selectExpr("cast(id as int) as from_thread", "cast(id + 1 as int) as to_thread")
    assert continuity.merge_cycles(edges).count() == 0


def test_shapes(spark):
    rows = [(1, 5, 1, 1, 5.0, 0.0, 0.0), (2, 50, 10, 10, 9.0, 0.1, 0.1), (3, 50, 5, 10, 1.0, 0.9, 0.9), (4, 50, 5, 10, 1.1, 0.8, 0.05), (5, 50, 10, 10, 0.5, 0.05, 0.2), (6, 50, 2, 10, 1.05, 0.06, 0.3)]
    df = spark.createDataFrame(rows, "label int, n int, weeks int, span_weeks int, burstiness double, drift double, directionality double")
    assert {r.label: r["shape"] for r in continuity.shape_tags(df).collect()} == {1: "brief mention", 2: "spike and decay", 3: "directional", 4: "churn", 5: "heartbeat", 6: "topical thread"}


def test_divergence_of_one_and_of_all(spark):
    df = spark.createDataFrame([("a", "x", 1, 10), ("b", "x", 1, 10), ("c", "y", 1, 5), ("a", "x", 2, 3)], "grp string, item string, period int, n int")
    got = {(r.period, r.grp): (r.divergence, r.lacks, r.alone) for r in continuity.divergence(df, "grp", "item", "period").collect()}
    assert got[1, "c"] == (1.0, 1, 1) and 0 < got[1, "a"][0] < 0.2 and got[2, "a"] == (None, 0, 0)
