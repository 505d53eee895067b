"""Shared pieces of the training-data operators: shared folder, tables that cut lineage, skew-safe lookups, linear scans."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts write it: \x20 and \x09 to \x0D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
ROW = "row"  # where `enclosed` keeps the input's columns


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder URL that driver and executors share: below spark.checkpoint.dir. Where that is unset a local master gets a temporary folder (tests); on a cluster it is an error, as its executors see no folder of the driver."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of `materialize` that nothing reads any more: what was made of them is written, too."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Within it, what is written passes to Python in Arrow batches of so many rows, and 16 MB, at most."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def enclosed(docs: DataFrame) -> DataFrame:
    """docs as one struct column, so that an operator's own columns can stand beside it whatever the names inside."""
    return docs.select(F.struct(F.col("*")).alias(ROW))


def released(df: DataFrame) -> DataFrame:
    """The columns that `enclosed` put together."""
    return df.select(f"{ROW}.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_array(text: Column) -> Column:
    """Words of ASCII-white-space separated text as an array; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda's argument is, an expression that is named twice isn't."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(items: Column, zero: Column, kind: str, step: Callable[[Column, Column], Column], size: int = 256) -> Column:
    """The states (of the SQL type `kind`) after each of the items, step by step from zero.

    Arrays can only grow by being copied, so states are gathered in pieces of `size` and the pieces are joined: n items cost n * (size + n / size**2) copies, not n * n."""

    def piece(last: Column, part: Column) -> Column:
        start = F.struct(last.alias("last"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(part, start, lambda s, x: let(step(s["last"], x).cast(kind), lambda now: F.struct(now.alias("last"), F.concat(s["out"], F.array(now)).alias("out"))))

    def whole(all_: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / size).cast("int")), lambda k: F.slice(all_, k * size + 1, F.lit(size)))
        start = F.struct(zero.cast(kind).alias("last"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        out = F.aggregate(parts, start, lambda s, part: let(piece(s["last"], part), lambda now: F.struct(now["last"].alias("last"), F.concat(s["out"], F.array(now["out"])).alias("out"))), lambda s: s["out"])
        return F.when(F.size(all_) > 0, F.flatten(out)).otherwise(F.array().cast(f"array<{kind}>"))

    return let(items, whole)


HOT_SHARE = 1000


def lookup(rows: DataFrame, key: str, keyed: DataFrame, total: int) -> DataFrame:
    """Left join of rows with keyed (one row a key, a `members` column with the rows a key has in `rows`).

    Keys with more than total/HOT_SHARE rows number HOT_SHARE at most, so they are broadcast; the rest meet in an ordinary join whose largest key holds a thousandth of the rows."""
    at = max(1, total // HOT_SHARE)
    hot = F.broadcast(keyed.where(F.col("members") > at)).withColumn("_hot", F.lit(True))
    joined = rows.join(hot, key, "left")
    cold = joined.where(F.col("_hot").isNull()).select(*rows.columns).join(keyed.where(F.col("members") <= at), key, "left")
    return joined.where("_hot").drop("_hot").unionByName(cold)
