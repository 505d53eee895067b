from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from millrace.streaming import jobs


def _stream(spark, tmp_path, df):
    df.write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def _run(df, mode, name, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_weekly_counts_agree_with_the_batch(spark, tmp_path):
    day = lambda d: datetime.datetime(2024, 1, d, 12)
    df = spark.createDataFrame([(1, day(1)), (1, day(7)), (1, day(8)), (2, day(14))], "user_id int, ts timestamp")
    batch = sorted(map(tuple, jobs.weekly_counts(df, "user_id").collect()))
    assert batch == [(1, datetime.date(2024, 1, 1), 2), (1, datetime.date(2024, 1, 8), 1), (2, datetime.date(2024, 1, 8), 1)]
    assert sorted(map(tuple, _run(jobs.weekly_counts(_stream(spark, tmp_path, df), "user_id"), "complete", "weekly", tmp_path).collect())) == batch


def test_first_seen(spark, tmp_path):
    now = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", now), ("a", now), ("b", now)], "url string, ts timestamp")
    out = _run(jobs.first_seen(_stream(spark, tmp_path, df), ["url"], "ts"), "append", "seen", tmp_path)
    assert sorted(r.url for r in out.collect()) == ["a", "b"]


def test_rate_limiter_holds_its_state(spark, tmp_path):
    df = spark.createDataFrame([("k", float(t)) for t in (0, 1, 2, 3, 11, 12)], "key string, at double")
    out = _run(jobs.rate_limited(_stream(spark, tmp_path, df.coalesce(1)), 10.0, 3), "append", "limited", tmp_path)
    assert [r.allowed for r in out.orderBy("at").collect()] == [True, True, True, False, True, True]


def test_waves_resume(spark, tmp_path):
    stream = _stream(spark, tmp_path, spark.range(1000).select("id", F.lit("x").alias("text")))
    seen = []
    for _ in range(2):
        jobs.in_waves(stream, lambda df, epoch: seen.append(df.count()), str(tmp_path / "waves")).awaitTermination()
    assert sum(seen) == 1000
