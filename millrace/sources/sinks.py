"""Writes: runs that become visible at once, partitions replaced in place, snapshots, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_run(tables: dict[str, DataFrame], folder: str, run_id: str) -> None:
    """All tables of a run in a folder of its own; only then the pointer names it. A reader sees the old run whole, or the new one."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/runs/{run_id}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(run_id,)], "run_id string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{folder}/active")


def active_run(spark: SparkSession, folder: str) -> str:
    """The run that the pointer named last."""
    return spark.read.schema("run_id string, at timestamp").json(f"{folder}/active").orderBy(F.desc("at"), F.desc("run_id")).first()[0]


def read_run(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/runs/{active_run(spark, folder)}/{name}")


def replace_partitions(df: DataFrame, folder: str, keys: list[str]) -> None:
    """Writes df by partition; partitions that df has are replaced, others stay."""
    df.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(folder)


def publish(row: DataFrame, folder: str) -> None:
    """Appends a one-row snapshot; the last one counts."""
    row.withColumn("created_at", F.current_timestamp()).coalesce(1).write.mode("append").json(folder)


def latest(spark: SparkSession, folder: str) -> dict:
    """The last snapshot as plain values."""
    return json.loads(spark.read.json(folder).orderBy(F.desc("created_at")).limit(1).toJSON().first())


def markdown_table(df: DataFrame, most: int = 50) -> str:
    """The first rows as a markdown table, for reports on the driver."""
    rows = df.limit(most).collect()
    cell = lambda v: "" if v is None else f"{v:,.2f}" if isinstance(v, float) else str(v).replace("|", "/")
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(df.columns), "|" + "---|" * len(df.columns), *(line([cell(v) for v in r]) for r in rows)])


def ranking_report(title: str, ranking: DataFrame, absent: DataFrame, caveat: str = "") -> str:
    """A ranking with the groups that have no answer, which are named, never dropped."""
    missing = [str(r[0]) for r in absent.collect()]
    parts = [f"## {title}", markdown_table(ranking), f"Not available: {', '.join(missing)}." if missing else "Available for every group."]
    return "\n\n".join([*parts, *([caveat] if caveat else [])])
