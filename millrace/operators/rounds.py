"""Tables that iterations write between their rounds, in the shared folder, so that a round reads the last one only."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local master gets a temporary folder; on a cluster, whose executors don't see the driver's folders, it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder: what is read from it has no lineage, and a lost executor costs a task."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def indexed(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df, written, with `idx`, a row's place from 0 among those of its group in the given order, and `size`, their number. group and order tell rows apart, and group has no nulls.

    Rows are range-sorted; a row's place in its partition plus the group's rows in the partitions before is its index. No task orders a whole group."""
    dealt = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    placed = written(dealt.withColumns({"part": F.spark_partition_id(), "pos": F.monotonically_increasing_id()}), name)
    runs = placed.groupBy("part", *group).agg(F.count(F.lit(1)).alias("rows"), F.min("pos").alias("first"))
    before = F.sum("rows").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumns({"before": F.coalesce(before, F.lit(0)), "size": F.sum("rows").over(Window.partitionBy(*group))}).drop("rows")
    return placed.join(runs, ["part", *group]).withColumn("idx", F.col("pos") - F.col("first") + F.col("before")).drop("part", "pos", "first", "before")
